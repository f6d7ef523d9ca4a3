"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.llm import distinct_counts, heavy_hitters, mixing, packing, sentences, similar_vectors, tokens
from telemill.session import all_rows, cut_lineage, stored, table

DIMS = ["service", "env", "operation"]
#: Rows up to which a checked small table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """Written once; broadcast only if it is proven small."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _event_date() -> Column:
    return F.coalesce(F.to_date("event_ts"), F.date_from_unix_date(F.floor(F.col("ts_unix") / 86_400).cast("int")))


def _day_number(date: Column) -> Column:
    return (F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)).cast("long")


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# 1. Distinct users


def _user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.coalesce(_blank(F.lower(F.trim("user_id"))), _blank(F.lower(F.trim("account_id"))))
    return table(spark, sf_dir, "log_events").select(_event_date().alias("day"), F.coalesce(_blank(F.col("service")), F.lit("unknown")).alias("service"), "env", "operation", user.alias("user")).where(F.col("day").isNotNull() & F.col("user").isNotNull())


def p1_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, combo, service, env, operation, users, rel_error, at_least, at_most of every day and combination."""
    base = distinct_counts.sketch(_user_rows(spark, sf_dir), ["day", *DIMS], "user")
    return distinct_counts.estimate(distinct_counts.combinations(base, "day", DIMS), ["day", "combo", *DIMS])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda k: F.col("labels")[k]
    text = F.trim(label("unique_users"))
    kept = [F.when(c.isNotNull(), F.lit(1 << b)).otherwise(F.lit(0)) for b, c in enumerate((F.col("service"), label("env"), label("operation")))]
    reported = table(spark, sf_dir, "daily_aggregates").select(
        "agg_id",
        F.date_from_unix_date(F.floor(F.col("window_start") / 86_400).cast("int")).alias("day"),
        (kept[0] + kept[1] + kept[2]).alias("combo"),
        F.col("service"),
        label("env").alias("env"),
        label("operation").alias("operation"),
        F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("double")).alias("reported"),
    )
    groups = ["day", "combo", *DIMS]
    same = lambda a, b: [a[g].eqNullSafe(b[g]) for g in groups]
    counts = p1_distinct_users(spark, sf_dir).alias("c")
    r = reported.alias("r")
    bound = lambda c: F.coalesce(counts[c], F.lit(0.0)).alias(c)
    judged = r.join(counts, same(r, counts), "left").select(*[r[c] for c in reported.columns], bound("at_least"), bound("at_most"))
    # A report is right for counts from reported / 1.1 to reported / 0.9. Where the bounds of the count lie on both sides of
    # one of these, the sketch can't decide; an exact recount of those groups follows.
    least, most = F.col("reported") / 1.1, F.col("reported") / 0.9
    right = (F.col("at_least") >= least) & (F.col("at_most") <= most)
    wrong = F.col("reported").isNull() | (F.col("at_most") < least) | (F.col("at_least") > most)
    judged = cut_lineage(judged.withColumn("unsure", F.col("reported").isNotNull() & ~right & ~wrong).withColumn("wrong", wrong))
    doubtful = judged.where("unsure").select(*groups).distinct()
    combos = [x["combo"] for x in doubtful.select("combo").distinct().limit(8).collect()]
    exact = _recount(_user_rows(spark, sf_dir), _small(doubtful), combos, groups).alias("e")
    u = judged.where("unsure").alias("u")
    users = F.coalesce(exact["exact_users"], F.lit(0))
    recounted = u.join(exact, same(u, exact), "left").where(F.abs(u["reported"] - users) > 0.1 * users).select(u["agg_id"])
    return judged.where("NOT unsure AND wrong").select("agg_id").unionAll(recounted)


def _recount(rows: DataFrame, wanted: DataFrame, combos: list[int], groups: list[str]) -> DataFrame:
    """Exact distinct users of the wanted groups, of which combos are the combinations."""
    wide = rows.withColumn("combo", F.explode(F.array(*[F.lit(c) for c in combos]) if combos else F.array().cast("array<int>")))
    wide = wide.withColumns({d: F.when(F.col("combo").bitwiseAND(F.lit(1 << b)) != 0, F.col(d)) for b, d in enumerate(DIMS)})
    none = F.lit("\u0000")
    key = lambda df: [F.coalesce(df[g].cast("string"), none) for g in groups]
    w = wanted
    on = [F.col("wide_key") == F.col("wanted_key")]
    wide = wide.withColumn("wide_key", F.concat_ws("\u0001", *key(wide)))
    w = w.select(F.concat_ws("\u0001", *key(w)).alias("wanted_key"))
    return wide.join(w, on, "left_semi").groupBy(*groups).agg(F.count_distinct("user").alias("exact_users"))


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, combo, n_groups, n_beyond: groups of every combination, and those whose true count lies outside the bounds."""
    rows = _user_rows(spark, sf_dir)
    users = rows.groupBy("day", *DIMS, "user").agg(F.lit(1).alias("one")).drop("one")
    wide = users.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(DIMS) - 1))))
    kept = [(F.col("combo").bitwiseAND(F.lit(1 << b)) == 0) | F.col(d).isNotNull() for b, d in enumerate(DIMS)]
    wide = wide.where(kept[0] & kept[1] & kept[2]).withColumns({d: F.when(F.col("combo").bitwiseAND(F.lit(1 << b)) != 0, F.col(d)) for b, d in enumerate(DIMS)})
    exact = wide.groupBy("day", "combo", *DIMS).agg(F.count_distinct("user").alias("n"))
    found = p1_distinct_users(spark, sf_dir)
    same = [exact[g].eqNullSafe(found[g]) for g in ["day", "combo", *DIMS]]
    beyond = found["users"].isNull() | ~exact["n"].between(found["at_least"], found["at_most"])
    return exact.join(found, same, "left").groupBy(exact["day"], exact["combo"]).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(beyond).alias("n_beyond"))


# 2. Most frequent items


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_day, endpoint, user_id of every log record as first delivered, in order of the day; rows without an id count each.

    Written once: the sketch and the recount of its candidates read the same records.
    """
    endpoint = F.substring_index(F.lower("endpoint"), "?", 1)
    endpoint = F.when(endpoint.endswith("/"), endpoint.substr(F.lit(1), F.length(endpoint) - 1)).otherwise(endpoint)
    raw = table(spark, sf_dir, "log_events").select(
        "log_id", F.when(F.col("log_id").isNull(), F.monotonically_increasing_id()).alias("lone"), "ts_unix",
        _day_number(_event_date()).cast("int").alias("event_day"), _blank(endpoint).alias("endpoint"), _blank(F.lower(F.trim("user_id"))).alias("user_id"),
    )
    # A window has one sort; an aggregate of structs would sort before and after its shuffle.
    by_arrival = Window.partitionBy("log_id", "lone").orderBy("ts_unix", "event_day", "endpoint", "user_id")
    first = raw.withColumn("copy", F.row_number().over(by_arrival)).where("copy = 1")
    placed = heavy_hitters.place(first.select("event_day", "endpoint", "user_id", "log_id"), "event_day", F.xxhash64("log_id", "user_id", "endpoint"))
    return stored(placed.select("event_day", "endpoint", "user_id"))


def _top_items(records: DataFrame) -> DataFrame:
    """event_day, field, item, at_least, at_most, total of every item that may reach 1 percent of its day."""
    sketches = stored(heavy_hitters.sketch(records, "event_day", ["endpoint", "user_id"], placed=True))
    found = heavy_hitters.frequent_items(sketches).where(F.col("at_most") * 100 >= F.col("total"))
    return found.withColumn("grp", F.col("grp").cast("long")).withColumnRenamed("grp", "event_day")


def p2_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_items(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    candidates = _small(_top_items(records))
    # The sketch bounds each count; an exact count of the candidates alone decides those near the limit.
    both = F.array(F.struct(F.lit("endpoint").alias("field"), F.col("endpoint").alias("item")), F.struct(F.lit("user_id").alias("field"), F.col("user_id").alias("item")))
    items = records.select(F.col("event_day").cast("long").alias("event_day"), F.inline(both)).where("item IS NOT NULL")
    counted = items.join(candidates, ["event_day", "field", "item"], "left_semi").groupBy("event_day", "field", "item").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(candidates, ["event_day", "field", "item"]).where(F.col("n") * 100 >= F.col("total")).select("event_day", "field", "item")


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_day, field, total, n_missing, n_outside: items above 1 percent that the sketch misses, and true counts outside its bounds."""
    records = _records(spark, sf_dir)
    both = F.array(F.struct(F.lit("endpoint").alias("field"), F.col("endpoint").alias("item")), F.struct(F.lit("user_id").alias("field"), F.col("user_id").alias("item")))
    cells = records.select(F.col("event_day").cast("long").alias("event_day"), F.inline(both)).groupBy("event_day", "field", "item").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("event_day", "field").agg(F.sum("n").alias("all"))
    found = _top_items(records)
    joined = cells.where("item IS NOT NULL").join(totals, ["event_day", "field"]).join(found, ["event_day", "field", "item"], "left")
    missing, outside = F.col("total").isNull() & (F.col("n") * 100 >= F.col("all")), F.col("total").isNotNull() & ~(F.col("n").between(F.col("at_least"), F.col("at_most")) & (F.col("total") == F.col("all")))
    return joined.groupBy("event_day", "field").agg(F.max("all").alias("total"), F.count_if(missing).alias("n_missing"), F.count_if(outside).alias("n_outside"))


# 6. Similar vectors


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.nearest(table(spark, sf_dir, "aggregate_vectors"), "vec_id", "vector").withColumnRenamed("id", "vec_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = stored(p6_neighbours(spark, sf_dir).withColumnRenamed("vec_id", "id"))
    return similar_vectors.close_pairs(near, 0.9, table(spark, sf_dir, "aggregate_vectors"), "vec_id", "vector")


# 8. Packing


def _token_counts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return cut_lineage(tokens.with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id", *keep]))


def _packed(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame, packing.Plan]]:
    sizes = _token_counts(spark, sf_dir).where(F.col("doc_id").isNotNull())
    names = [(r["pack_name"], r["capacity_tokens"]) for r in all_rows(table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0"), 100)]
    return [(name, capacity, *packing.pack(sizes, "doc_id", "tokens", capacity)) for name, capacity in names]


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, pack_id, doc_id, piece_no, token_start, tokens: where every text goes, for every pack size."""
    out = None
    for name, _, packs, _ in _packed(spark, sf_dir):
        part = packs.select(F.lit(name).alias("pack_name"), "pack_id", F.col("item").alias("doc_id"), "piece_no", "token_start", "tokens")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "pack_name string, pack_id long, doc_id long, piece_no int, token_start long, tokens long")


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, capacity, packs, tokens, unused (share), unused_one_bucket (share if batches held one bucket only)."""
    made = _packed(spark, sf_dir)
    out = None
    for name, capacity, packs, plan in made:
        part = packs.agg(F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity"), F.lit(plan.batches).cast("long").alias("packs"), F.sum("tokens").alias("tokens"))
        part = part.withColumn("unused", 1 - F.try_divide("tokens", F.col("packs") * capacity)).withColumn("unused_one_bucket", F.lit(plan.unused_one_bucket))
        out = part if out is None else out.unionAll(part)
    return out


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, texts, n_over, n_gaps, n_split: packs above the capacity, texts that aren't packed whole and once, texts split that fit."""
    packs = p8_packs(spark, sf_dir)
    names = F.broadcast(table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0").select("pack_name", "capacity_tokens"))
    over = packs.groupBy("pack_name", "pack_id").agg(F.sum("tokens").alias("t")).join(names, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    pieces = packs.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"), F.count_distinct("token_start").alias("starts"))
    sizes = _token_counts(spark, sf_dir).where("tokens > 0")
    packed = [r["pack_name"] for r in all_rows(names, 100)]
    whole = (F.col("t") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("starts") == F.col("n"))
    every = sizes.withColumn("pack_name", F.explode(F.array(*[F.lit(n) for n in packed]))).join(names, "pack_name").join(pieces, ["pack_name", "doc_id"], "left")
    texts = every.groupBy("pack_name").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_gaps"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_split"))
    return texts.join(over, "pack_name").select("pack_name", "texts", "n_over", "n_gaps", "n_split")


# 9. Mixing


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, repeats of every document of the mix."""
    wanted = all_rows(table(spark, sf_dir, "source_targets").select(mixing.source_name(F.col("source")).alias("source"), "target_share", "max_repeats"), 10_000)
    return mixing.mix(_token_counts(spark, sf_dir, "source"), "doc_id", "source", "tokens", [tuple(r) for r in wanted])


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, available, n_over, n_twice, off_target: texts of every target, rows above the cap, rows of one text, shares off by more than half a percent and the largest text."""
    mixed, targets = cut_lineage(p9_mix(spark, sf_dir)), table(spark, sf_dir, "source_targets").select(mixing.source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    got = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("repeats").alias("repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("t"), F.max("tokens").alias("most"))
    got = got.join(F.broadcast(targets.select("source", "max_repeats")), "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_over"), F.count_if(F.col("rows") > 1).alias("n_twice"), F.sum("t").alias("t"), F.max("most").alias("most"))
    there = table(spark, sf_dir, "documents").where("text <> '' AND doc_id IS NOT NULL").groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("available"))
    joined = targets.join(there, "source", "left").join(got, "source", "left").na.fill(0)
    all_t, all_w = F.sum("t").over(Window.partitionBy()), F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(Window.partitionBy())
    off = F.when(F.col("available") > 0, F.abs(F.col("t") / all_t - F.col("target_share") / all_w) > 0.005 + F.max("most").over(Window.partitionBy()) / all_t).otherwise(F.col("t") > 0)
    return joined.select("source", "available", "n_over", "n_twice", off.alias("off_target"))


# 10. Sentences


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_rows(table(spark, sf_dir, "documents"))


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_chars of the sentences of every document that has any."""
    found = p10_found(spark, sf_dir)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("n_chars"))


def p10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_outside, n_overlapping, n_blank: sentences that leave their text, reach into the one before, or begin or end with a blank."""
    found = p10_found(spark, sf_dir)
    before = F.lag("sent_end").over(Window.partitionBy("doc_id").orderBy("sent_start", "sent_end"))
    text = F.col("text")
    at = lambda i: F.substring(text, i.cast("int"), F.lit(1))
    blank = at(F.col("sent_start") + 1).rlike(r"^\s$") | at(F.col("sent_end")).rlike(r"^\s$")
    joined = found.withColumn("before", before).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.agg(F.count_if((F.col("sent_start") < 0) | (F.col("sent_end") > F.length(text)) | (F.col("sent_start") >= F.col("sent_end"))).alias("n_outside"), F.count_if(F.col("before") > F.col("sent_start")).alias("n_overlapping"), F.count_if(blank).alias("n_blank"))


_LOGS_SQL = """l AS (SELECT log_id, ts_unix, coalesce(event_ts::DATE, make_timestamp(ts_unix * 1000000)::DATE) AS day, coalesce(nullif(service, ''), 'unknown') AS svc, env, operation,
  coalesce(nullif(lower(trim(user_id)), ''), nullif(lower(trim(account_id)), '')) AS usr, nullif(regexp_replace(split_part(lower(endpoint), '?', 1), '/$', ''), '') AS endpoint, nullif(lower(trim(user_id)), '') AS user_id FROM log_events)"""

ORACLE_SQL = {
    "p1_found": f"""WITH {_LOGS_SQL}, c AS (SELECT day, svc, env, operation, grouping(svc) AS gs, grouping(env) AS ge, grouping(operation) AS go, count(DISTINCT usr) AS n FROM l GROUP BY day, CUBE (svc, env, operation)),
      d AS (SELECT agg_id, make_timestamp(window_start * 1000000)::DATE AS day, service, labels['env'] AS env, labels['operation'] AS operation,
            CASE WHEN regexp_matches(trim(labels['unique_users']), '^[+-]?[0-9]+$') THEN trim(labels['unique_users'])::DOUBLE END AS u FROM daily_aggregates)
      SELECT agg_id FROM d LEFT JOIN c ON c.day = d.day AND gs = (service IS NULL)::INT AND ge = (d.env IS NULL)::INT AND go = (d.operation IS NULL)::INT
        AND (service IS NULL OR svc = service) AND (d.env IS NULL OR c.env = d.env) AND (d.operation IS NULL OR c.operation = d.operation)
      WHERE u IS NULL OR abs(u - coalesce(n, 0)) > 0.1 * coalesce(n, 0)""",
    "p2_found": f"""WITH {_LOGS_SQL}, o AS (SELECT DISTINCT ON (log_id) * FROM l ORDER BY log_id, ts_unix), t AS (SELECT day, count(*) AS n FROM o GROUP BY ALL),
      v AS (SELECT day, 'endpoint' AS field, endpoint AS item FROM o UNION ALL SELECT day, 'user_id', user_id FROM o), k AS (SELECT day, field, item, count(*) AS k FROM v WHERE item IS NOT NULL GROUP BY ALL)
      SELECT (year(day) * 10000 + month(day) * 100 + day(day))::BIGINT AS event_day, field, item FROM k JOIN t USING (day) WHERE k.k * 100 >= t.n""",
    "p6_found": """WITH g AS (SELECT vec_id, vector::DOUBLE[128] AS v FROM aggregate_vectors WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM g a JOIN g b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p)
      SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE k <= 5 AND c >= 0.9""",
    "p1_errors": f"""WITH {_LOGS_SQL}, u AS (SELECT day, svc, env, operation FROM l WHERE usr IS NOT NULL AND day IS NOT NULL), x AS (SELECT day, svc, env, operation, unnest(range(0, 8)) AS combo FROM u),
      g AS (SELECT DISTINCT day, combo, CASE WHEN combo & 1 <> 0 THEN svc END AS a, CASE WHEN combo & 2 <> 0 THEN env END AS b, CASE WHEN combo & 4 <> 0 THEN operation END AS c FROM x
            WHERE (combo & 1 = 0 OR svc IS NOT NULL) AND (combo & 2 = 0 OR env IS NOT NULL) AND (combo & 4 = 0 OR operation IS NOT NULL))
      SELECT day, combo::INT AS combo, count(*) AS n_groups, 0::BIGINT AS n_beyond FROM g GROUP BY ALL""",
    "p2_bounds": f"""WITH {_LOGS_SQL}, o AS (SELECT DISTINCT ON (log_id) * FROM l ORDER BY log_id, ts_unix), v AS (SELECT day, 'endpoint' AS field, endpoint AS item FROM o UNION ALL SELECT day, 'user_id', user_id FROM o)
      SELECT (year(day) * 10000 + month(day) * 100 + day(day))::BIGINT AS event_day, field, count(*) AS total, 0::BIGINT AS n_missing, 0::BIGINT AS n_outside FROM v GROUP BY ALL HAVING count(item) > 0""",
    "p8_cover": "SELECT pack_name, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS n_over, 0::BIGINT AS n_gaps, 0::BIGINT AS n_split FROM pack_sizes WHERE capacity_tokens > 0",
    "p9_checks": """WITH d AS (SELECT replace(lower(trim(source)), '-', '_') AS source, count(*) AS available FROM documents WHERE text <> '' GROUP BY ALL)
      SELECT replace(lower(trim(t.source)), '-', '_') AS source, coalesce(available, 0) AS available, 0::BIGINT AS n_over, 0::BIGINT AS n_twice, false AS off_target FROM source_targets t LEFT JOIN d ON d.source = replace(lower(trim(t.source)), '-', '_')""",
    "p10_checks": "SELECT 0::BIGINT AS n_outside, 0::BIGINT AS n_overlapping, 0::BIGINT AS n_blank",
}

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_distinct_users, p1_errors, p2_found, p2_top_items, p2_bounds, p6_found, p6_neighbours, p8_packs, p8_usage, p8_cover, p9_mix, p9_shares, p9_checks, p10_found, p10_lengths, p10_checks)
}
