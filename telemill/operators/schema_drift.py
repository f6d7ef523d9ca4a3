"""Files whose fields drift: one consistent table and a report of every change.

Every (feed, file, field) gets a mergeable profile by plain aggregation: how
many lines hold it, its types, a min-hash sketch of its values, the mix of
character classes, and the spread of its numbers. A file is compared with the
one before it in its feed. Fields that only one side has may be renames: a
bipartite assignment between the removed and the added fields maximises the
likeness of content, with the likeness of names as the tie-breaker; pairs that
carry the same content are renames, the others are removed or added.

Scale: lines are aggregated to profiles with map-side combine (a hot feed or
file is many partial aggregates, not one task); comparisons group by (feed,
file), whose profiles are bounded, since a field belongs to a file only if at
least half of its lines hold it. Renames are linked to the one before of their
key by a window over (feed, key) and led back to their field by pointer doubling;
a window over (feed, field) tells every file's name of it. The unified table is
one join of lines with the small mapping of their file.

Defined results: lines that aren't JSON objects are left out of profiles and
give a row of nulls in the unified table; null values count for presence but
not for types; a file without JSON objects holds no field; of types with
equal counts the alphabetically first wins; a field whose values are all null
has no type and is never retyped; rows without feed or file number are left
out; empty tables give empty results; extra columns are ignored. In the unified table a
value that doesn't read as its field's type is null, a number with a fraction is no
long, and an object with one plain member, {"name": "x"}, stands for that member
where the field is a string.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.frames import frame
from telemill.session import cut_lineage, stored

N_HASH = 24
#: Classes of characters: those to count, or a pattern of those to leave out.
_CHARS = {"digit": "0123456789", "alpha": r"[^\p{L}]", "slash": "/", "dash": "-", "dot": "."}
_TYPES = ("array", "boolean", "number", "object", "string")
_CHANGES = "feed string, file_no long, change_kind string, field string, new_name string"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """feed, file_no, line_no, v: the lines that are JSON objects."""
    body = F.trim("raw")
    return (
        lines.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull() & body.startswith("{") & body.endswith("}"))
        .select("feed", F.col("file_no").cast("long").alias("file_no"), "line_no", F.try_parse_json(body).alias("v"))
        .where(F.col("v").isNotNull())
    )


def profiles(lines: DataFrame) -> DataFrame:
    """One row per (feed, file_no, key) that belongs to the file."""
    objects = parsed_lines(lines)
    exploded = objects.lateralJoin(lines.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select("feed", "file_no", "pos", "key", "value")
    kind = F.schema_of_variant("value")
    typed = exploded.select(
        "feed", "file_no", "key", (F.coalesce("pos", F.lit(0)) == 0).alias("first"),
        F.when(kind == "VOID", None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number").alias("kind"),
        F.when(kind != "VOID", F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).otherwise(F.to_json("value"))).alias("text"),
    )
    typed = typed.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    size = F.log10(F.abs(F.col("text").try_cast("double")) + 1e-6)

    def share(chars: str) -> Column:
        n = F.length("text")
        held = F.length(F.regexp_replace("text", chars, "")) if chars.startswith("[^") else n - F.length(F.translate("text", chars, ""))
        return F.coalesce(held.cast("double"), F.lit(0.0)) / F.greatest(n, F.lit(1))

    stats = typed.groupBy("feed", "file_no", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("text").alias("n_value"),
        *[F.count_if(F.col("kind") == t).alias(f"n_{t}") for t in _TYPES],
        F.array(*[F.min(F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(i)))) for i in range(N_HASH)]).alias("sketch"),
        F.count_if("first").alias("n_first"),
        F.approx_count_distinct("text", 0.05).alias("n_distinct"),
        F.avg(F.length("text")).alias("len"),
        *[F.avg(share(chars)).alias(f"c_{name}") for name, chars in _CHARS.items()],
        F.count(size).alias("n_numeric"),
        F.avg(size).alias("mag"),
        F.stddev_pop(size).alias("mag_sd"),
    )
    counts = F.array(*[F.struct((-F.col(f"n_{t}")).alias("k"), F.lit(t).alias("t")) for t in _TYPES])
    main = F.array_min(counts)
    # Every object counts with its first key, so lines need no pass of their own.
    return (
        stats.withColumn("n_lines", F.sum("n_first").over(Window.partitionBy("feed", "file_no")))
        .where(F.col("key").isNotNull() & (F.col("n") * 2 >= F.col("n_lines")))
        .withColumn("type", F.when(main["k"] < 0, main["t"]))
        .drop("n_first", *[f"n_{t}" for t in _TYPES])
    )


def name_likeness(a: str, b: str) -> float:
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    return difflib.SequenceMatcher(None, norm(a), norm(b)).ratio()


def content_likeness(a: dict, b: dict) -> float:
    """0..1: whether two profiles carry the same content."""
    if not a["n_value"] or not b["n_value"]:
        return 0.0
    overlap = float(np.mean(np.asarray(a["sketch"]) == np.asarray(b["sketch"])))
    gap = sum(abs(a[f"c_{c}"] - b[f"c_{c}"]) for c in _CHARS)
    gap += 0.5 * abs(np.log((a["len"] + 1) / (b["len"] + 1)))
    numeric = [2 * p["n_numeric"] > p["n_value"] for p in (a, b)]
    if all(numeric):
        sd = max(0.02, a["mag_sd"], b["mag_sd"])
        gap += 0.5 * abs(a["mag"] - b["mag"]) / sd + abs(np.log((a["mag_sd"] + 0.01) / (b["mag_sd"] + 0.01))) * 0.3
    elif any(numeric):
        gap += 1.0
    if {a["type"], b["type"]} & {"array", "object"} and a["type"] != b["type"]:
        gap += 1.0
    shape = float(np.exp(-2.5 * gap))
    spread = min(a["n_distinct"] / a["n_value"], b["n_distinct"] / b["n_value"])
    # Few distinct values repeat between files, so their sketches must agree; identifiers and measures rarely repeat.
    weight = 1.0 if spread < 0.35 else max(0.0, (0.75 - spread) / 0.4) * 0.7
    return weight * min(1.0, 1.6 * overlap) * shape**0.25 + (1 - weight) * shape


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite assignment (Hungarian method, O(n^3))."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0, free = match[j0], np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def changes(profile: DataFrame, threshold: float = 0.4, name_bonus: float = 0.1) -> DataFrame:
    """feed, file_no, change_kind, field, new_name: every change of a file against the file before it."""
    profile = stored(profile)
    files = profile.select("feed", "file_no").distinct().withColumn("next_no", F.lead("file_no").over(Window.partitionBy("feed").orderBy("file_no")))
    both = profile.join(files, ["feed", "file_no"]).withColumn("side", F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("file_no").alias("at")), F.struct(F.lit(0).alias("s"), F.col("next_no").alias("at")))))
    first = profile.groupBy("feed").agg(F.min("file_no").alias("first_no"))
    both = both.where(F.col("side.at").isNotNull()).drop("next_no", "n_lines").withColumn("pair_no", F.col("side.at")).withColumn("is_new", F.col("side.s") == 1).drop("side")
    both = both.join(first, "feed").where(F.col("pair_no") > F.col("first_no"))

    # Fields that both sides have, and files where nothing goes or nothing comes, need no matching.
    both = both.repartition("feed", "pair_no")
    by_key, by_file = Window.partitionBy("feed", "pair_no", "key"), Window.partitionBy("feed", "pair_no")
    sides = both.withColumns({"sides": F.count(F.lit(1)).over(by_key), "least": F.min("type").over(by_key), "most": F.max("type").over(by_key)})
    sides = sides.where((F.col("sides") == 1) | (F.col("least") != F.col("most")))
    single = F.col("sides") == 1
    sides = sides.withColumn("matched", F.max(single & F.col("is_new")).over(by_file) & F.max(single & ~F.col("is_new")).over(by_file) & single)
    report = lambda rows, kind: rows.select("feed", F.col("pair_no").alias("file_no"), kind.alias("change_kind"), F.col("key").alias("field"), F.col("key").alias("new_name"))
    plain = report(sides.where(single & ~F.col("matched")), F.when(F.col("is_new"), "added").otherwise("removed")).unionAll(report(sides.where(~single & F.col("is_new")), F.lit("retyped")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        old = {r["key"]: r for r in pdf[~pdf["is_new"]].to_dict("records")}
        new = {r["key"]: r for r in pdf[pdf["is_new"]].to_dict("records")}
        gone, come, out = sorted(old), sorted(new), []
        content = np.array([[content_likeness(old[a], new[b]) for b in come] for a in gone])
        names = np.array([[name_likeness(a, b) for b in come] for a in gone])
        score = np.where(content >= threshold, content + name_bonus * names, 0.0)
        for i, j in assign(score):
            if score[i, j] > 0:
                out.append(("renamed", gone[i], come[j]))
        renamed = {f for _, f, _ in out}, {t for _, _, t in out}
        out += [("removed", k, k) for k in gone if k not in renamed[0]] + [("added", k, k) for k in come if k not in renamed[1]]
        return frame({"feed": pdf["feed"].iloc[0], "file_no": int(pdf["pair_no"].iloc[0]), "change_kind": [o[0] for o in out], "field": [o[1] for o in out], "new_name": [o[2] for o in out]})

    return plain.unionAll(sides.where("matched").groupBy("feed", "pair_no").applyInPandas(match, _CHANGES))


def rename_roots(change: DataFrame) -> DataFrame:
    """feed, file_no, root, new_name: every rename with the field that its chain of renames began with."""
    renames = change.where((F.col("change_kind") == "renamed") & F.col("field").isNotNull() & F.col("new_name").isNotNull()).select("feed", "file_no", "field", "new_name").distinct()
    # A file takes its old keys before it gives new ones, so ends of chains (0) come before beginnings (1).
    uses = renames.select("feed", "file_no", F.col("field").alias("key"), F.lit(0).alias("gives"), "field", "new_name").unionAll(renames.select("feed", "file_no", F.col("new_name").alias("key"), F.lit(1).alias("gives"), "field", "new_name"))
    w = Window.partitionBy("feed", "key").orderBy("file_no", "gives", "field")
    of = lambda c: F.lag(c).over(w)
    linked = uses.withColumns({"up": F.when(of("gives") == 1, F.struct(of("file_no").alias("file_no"), of("field").alias("field")))}).where("gives = 0").drop("key", "gives")
    # Pointers double until none is left: as many rounds as the binary digits of the longest chain.
    at = cut_lineage(linked.withColumn("root", F.when(F.col("up").isNull(), F.col("field"))))
    while at.where("root IS NULL").limit(1).count():
        above = at.select(F.col("feed").alias("f"), F.col("file_no").alias("n"), F.col("field").alias("k"), F.col("up").alias("next"), F.col("root").alias("found"))
        joined = at.join(above, (F.col("feed") == F.col("f")) & (F.col("up.file_no") == F.col("n")) & (F.col("up.field") == F.col("k")), "left")
        at = cut_lineage(joined.select("feed", "file_no", "field", "new_name", F.col("next").alias("up"), F.coalesce("root", "found").alias("root")))
    return at.select("feed", "file_no", "root", "new_name")


def field_names(lines: DataFrame, change: DataFrame, fields: list[str]) -> DataFrame:
    """feed, file_no, names map<field, key in that file>: renames followed along each feed."""
    files = lines.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).select("feed", F.col("file_no").cast("long").alias("file_no")).distinct()
    roots = rename_roots(change).where(F.col("root").isin(*fields))
    every = files.withColumn("root", F.explode(F.array(*[F.lit(f) for f in fields]))).withColumn("new_name", F.lit(None).cast("string"))
    # Renames of a file count for the file itself.
    w = Window.partitionBy("feed", "root").orderBy("file_no", F.col("new_name").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    named = every.unionByName(roots).withColumn("key", F.last("new_name", ignorenulls=True).over(w)).where("new_name IS NULL")
    pairs = F.collect_list(F.struct("root", F.coalesce("key", "root").alias("key")))
    return named.groupBy("feed", "file_no").agg(F.map_from_entries(pairs).alias("names"))


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        # An object with one string member, {"name": "x"}, stands for that member.
        inner = F.regexp_extract(text, r'^\{"[^"]*":"?([^"{}\[\],]*)"?\}$', 1)
        return F.when(text.startswith("{") & (inner != ""), inner).otherwise(text)
    if kind.startswith("array"):
        return F.when(text.startswith("["), F.from_json(text, kind))
    if kind == "long":
        number = text.try_cast("double")
        return F.coalesce(text.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))
    return text.try_cast(kind)


def unified_table(lines: DataFrame, names: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """feed, file_no, line_no and one typed column per (field, type), whatever the file called it."""
    body = F.trim("raw")
    parsed = lines.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).select(
        "feed", F.col("file_no").cast("long").alias("file_no"), "line_no",
        F.when(body.startswith("{") & body.endswith("}") & F.try_parse_json(body).isNotNull(), F.from_json(body, "map<string,string>")).alias("values"),
    )
    at = lambda f: F.col("values")[F.col("names")[f]]
    return parsed.join(names, ["feed", "file_no"]).select("feed", "file_no", "line_no", *[_typed(at(f), t).alias(f"{f}_field" if f in ("feed", "file_no", "line_no") else f) for f, t in fields])
