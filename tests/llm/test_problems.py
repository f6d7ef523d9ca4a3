"""The training-data problems against brute force, round trips and invariants."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import distinct_counts, heavy_hitters, mixing, packing, queries, sentences, similar_vectors, tokens

from ..oracle import DATA, assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("kind", ["empty", "wide", "nulls"])
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p6_found", "p8_packs", "p9_mix", "p10_found"])
def test_odd_tables(spark, sf, variant_dirs, name, kind):
    rows = queries.QUERIES[name](spark, variant_dirs[kind]).collect()
    if kind == "empty":
        assert not rows
    if kind == "wide":
        assert sorted(map(str, rows)) == sorted(map(str, queries.QUERIES[name](spark, sf).collect()))


# 1


@pytest.mark.parametrize("n", [0, 1, 100, 5_000, 60_000, 400_000])
def test_distinct_estimate_is_within_its_error(spark, n):
    ids = spark.range(n).selectExpr("'g' AS g", "concat('u', id) AS u")
    twice = ids.unionAll(ids.limit(1000)).unionAll(spark.createDataFrame([("g", None)], "g string, u string"))
    got = distinct_counts.estimate(distinct_counts.sketch(twice, ["g"], "u"), ["g"]).collect()
    if n == 0:
        assert not got
    else:
        assert abs(got[0]["users"] - n) <= max(0.6, 4 * got[0]["rel_error"] * n)


def test_partial_sketches_merge_to_the_whole(spark):
    ids = spark.range(30_000).selectExpr("'g' AS g", "id % 20000 AS u")
    whole = distinct_counts.sketch(ids, ["g"], "u")
    parts = distinct_counts.sketch(ids.where("u < 9000"), ["g"], "u").unionAll(distinct_counts.sketch(ids.where("u >= 8000"), ["g"], "u"))
    assert sorted(distinct_counts.merge(parts, ["g"]).collect()) == sorted(whole.collect())


def test_combinations_follow_their_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x", "u1"), (1, "a", "y", "u2"), (1, "b", "x", "u1"), (1, "b", None, "u3")], "day int, s string, e string, u string")
    sk = distinct_counts.combinations(distinct_counts.sketch(rows, ["day", "s", "e"], "u"), "day", ["s", "e"])
    got = {(r["combo"], r["s"], r["e"]): round(r["users"]) for r in distinct_counts.estimate(sk, ["day", "combo", "s", "e"]).collect()}
    assert got == {(0, None, None): 3, (1, "a", None): 2, (1, "b", None): 2, (2, None, "x"): 1, (2, None, "y"): 1, (3, "a", "x"): 1, (3, "a", "y"): 1, (3, "b", "x"): 1}


# 2


def test_heavy_hitters_bound_the_true_counts(spark):
    rng = np.random.default_rng(4)
    tail = [f"t{int(x)}" for x in rng.integers(0, 50_000, 60_000)]
    heavy = [f"h{i}" for i in range(20) for _ in range(900 + 37 * i)]
    everything = heavy + tail + ["hot"] * 40_000 + [None] * 500
    rng.shuffle(everything)
    df = spark.createDataFrame([("g", x) for x in everything], "grp string, item string").repartition(7)
    got = {r["item"]: r for r in heavy_hitters.frequent_items(heavy_hitters.sketch(df, "grp", "item")).collect()}
    true = collections.Counter(everything)
    wanted = {x for x, n in true.items() if x is not None and n * 100 >= len(everything)}
    assert wanted <= set(got)
    assert all(r["at_least"] <= true[x] <= r["at_most"] and r["total"] == len(everything) for x, r in got.items())
    assert all(got[x]["at_most"] - got[x]["at_least"] <= 0.002 * len(everything) for x in wanted)


def test_many_groups_stay_within_memory(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i % 200}", f"x{i % 3}") for i in range(2000)], "grp string, item string").coalesce(1)
    got = heavy_hitters.frequent_items(heavy_hitters.sketch(df, "grp", "item")).groupBy("grp").agg(F.sum("at_least").alias("n"), F.max("total").alias("t")).collect()
    assert len(got) == 200 and all(r["n"] == r["t"] == 10 for r in got)


# 6


def test_hilbert_keys_are_a_curve():
    side, bits = 8, 3
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    key = similar_vectors.hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(side * side))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_against_brute_force(spark):
    path = f"{DATA}/sf0.1"
    rows = spark.read.parquet(f"{path}/aggregate_vectors.parquet")
    pdf = similar_vectors.usable_vectors(rows, "vec_id", "vector", 128).toPandas()
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    ids = pdf["id"].to_numpy()
    want = {(int(ids[i]), int(ids[j])) for i, js in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in js}
    got = {(r["id"], r["neighbour"]) for r in similar_vectors.nearest(rows, "vec_id", "vector").collect()}
    assert len(want & got) >= 0.9 * len(want)
    close = {(a, b) for a, b in want if s[pdf.index[pdf["id"] == a][0], pdf.index[pdf["id"] == b][0]] >= 0.9}
    assert close <= got


def test_copies_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(900)] + [(1000, [0.0] * 4), (1001, None), (1002, [1.0] * 3), (1003, [float("nan")] * 4), (1004, [4.0, 3.0, -2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = similar_vectors.nearest(df, "id", "vector", dim=4, dims=2, curves=4).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect()
    assert {r["id"] for r in got} == {*range(900), 1004}
    assert all(r["n"] == 5 and (r["id"] == 1004 or r["c"] > 0.9999) for r in got)
    two = similar_vectors.nearest(df.where("id IN (1, 1004)"), "id", "vector", dim=4, dims=2, curves=4).collect()
    assert {(r["id"], r["neighbour"]) for r in two} == {(1, 1004), (1004, 1)}
    assert similar_vectors.nearest(df.where("id = 1"), "id", "vector", dim=4, dims=2, curves=4).collect() == []


# 8


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    texts = ["", None, "Hello world", "<|endoftext|>", "数据 ต้น " * 50, " \n\n\t x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()}
    e = tokens.encoding()
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)


def test_buckets_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(8)
    for _ in range(30):
        counts = np.zeros(13, int)
        counts[1:] = rng.integers(0, 6, 12)
        lengths = [i for i in range(13) if counts[i]]
        for k in (1, 2, 3):
            def padding(bounds):
                return sum(counts[i] * (min(b for b in bounds if b >= i) - i) for i in lengths)

            best = min((padding([*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1], r)), default=0)
            assert padding(packing.length_buckets(counts, k)) == best


def test_packs_hold_everything_once(spark):
    rng = np.random.default_rng(6)
    sizes = [*np.minimum(rng.lognormal(6, 0.9, 4000).astype(int) + 1, 30_000).tolist(), *[700] * 2000, 0, None, -3, 5000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(9999, 100), (9999, 100)], "id long, n long")
    packs, plan = packing.pack(df, "id", "n", 1024, rows_per_shard=500)
    pdf = packs.toPandas()
    room = pdf.groupby("pack_id")["tokens"].sum()
    assert room.max() <= 1024 and len(room) == plan.batches and set(room.index) == set(range(plan.batches))
    want = collections.Counter({i: s for i, s in enumerate(sizes) if s and s > 0}) + collections.Counter({9999: 200})
    assert pdf.groupby("item")["tokens"].sum().to_dict() == dict(want)
    whole = pdf[pdf["item"].map(lambda i: i != 9999 and sizes[i] <= 1024)]
    assert whole.groupby("item").size().max() == 1
    least = max(-(-int(pdf["tokens"].sum()) // 1024), int((pdf["tokens"] > 512).sum()))
    assert plan.batches <= 1.06 * least
    exact = packing.plan(np.bincount(pdf["tokens"], minlength=1025), 1024, 1024)  # a bucket for every length
    assert plan.batches <= 1.01 * exact.batches
    assert 1 - pdf["tokens"].sum() / (1024 * plan.batches) < plan.unused_one_bucket


# 9


def test_sainte_lague_matches_plain_quotients():
    rng = np.random.default_rng(9)
    for _ in range(40):
        w = rng.random(5).tolist()
        seats, caps = int(rng.integers(0, 300)), [int(c) for c in rng.integers(0, 120, 5)]
        got = [0] * 5
        for _ in range(min(seats, sum(caps))):
            i = max((i for i in range(5) if got[i] < caps[i]), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        assert mixing.sainte_lague(w, seats, caps) == got


def test_mix_reaches_its_shares(spark):
    rng = np.random.default_rng(10)
    docs = [(i, ("big" if i % 3 else " Small-One "), int(s)) for i, s in enumerate(rng.lognormal(6, 0.7, 3000))] + [(5000, None, 100), (5001, "other", 100), (5002, "big", 0), (5003, "big", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = [("big", 0.4, 1), ("small_one", 0.5, 3), ("absent", 0.1, 5)]
    got = mixing.mix(df, "doc_id", "source", "tokens", targets, rows_per_shard=300)
    used = got.toPandas()
    share = used.assign(t=used["tokens"] * used["repeats"]).groupby("source")["t"].sum()
    assert share["big"] / share.sum() == pytest.approx(4 / 9, abs=0.01) and share["small_one"] / share.sum() == pytest.approx(5 / 9, abs=0.01)
    assert (used[used["source"] == "small_one"]["repeats"] <= 3).all() and (used[used["source"] == "big"]["repeats"] <= 1).all()
    assert not set(used["doc_id"]) & {5000, 5001, 5002, 5003}
    again = mixing.mix(df.repartition(5), "doc_id", "source", "tokens", targets, rows_per_shard=300).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, used.to_numpy().tolist()))
    capped = mixing.mix(df, "doc_id", "source", "tokens", targets, total=10**9).toPandas()
    assert (capped.groupby("source")["repeats"].min() == [1, 3]).all() and len(capped) == 3000


# 10

SPLIT = [
    ("Dr. Smith came at 5 p.m. He left, e.g. early. See Fig. 3.2 of vol. 5.", ["Dr. Smith came at 5 p.m.", "He left, e.g. early.", "See Fig. 3.2 of vol. 5."]),
    ("``It drifts!'' wrote the referee. (So it does, see p. 25.) Yes", ["``It drifts!'' wrote the referee.", "(So it does, see p. 25.)", "Yes"]),
    ("We set $x = 0.1.$ Each one\\footnote{Not all, see p. 2.} ends.\\footnote{Really.} pH is low.", ["We set $x = 0.1.$", "Each one\\footnote{Not all, see p. 2.} ends.\\footnote{Really.}", "pH is low."]),
    ("One goes on, so that\n\\begin{align}\n a &= b. \\\\\n\\end{align}\nwhere $a$ is it. % no. Not this.\nTwo.", ["One goes on, so that\n\\begin{align}\n a &= b. \\\\\n\\end{align}\nwhere $a$ is it.", "Two."]),
    ("One % a comment. Here.\ngoes on.\n\nTwo has no mark\n\n\\begin{equation}\n x = 1.\n\\end{equation}\n\n\\begin{comment}\nNot. This.\n\\end{comment}\n\\iffalse\nNor. This.\n\\fi\n", ["One % a comment. Here.\ngoes on.", "Two has no mark"]),
    ("\\section{A title. Of two}\nText.\n\\begin{itemize}\n\\item First\n\\item Second one. Third.\n\\end{itemize}\n\\begin{figure}\n\\caption{No. Prose.}\n\\end{figure}\n\\begin{thebibliography}{9}\n\\bibitem{a} A. B. No.\n\\end{thebibliography}", ["Text.", "First", "Second one.", "Third."]),
    ("Les trois, p. ex. ici, cf. éq. 5.1. « Est-ce stable ? » demande M. Un. Oui : « Cela va. » Non.", ["Les trois, p. ex. ici, cf. éq. 5.1.", "« Est-ce stable ? » demande M. Un.", "Oui : « Cela va. »", "Non."]),
    ("Am 1. Mai war es z.\\,B. gut, d. h. ca. 1,1 mm. „Gilt das?“ fragte er. Ende.", ["Am 1. Mai war es z.\\,B. gut, d. h. ca. 1,1 mm.", "„Gilt das?“ fragte er.", "Ende."]),
    ("В 1973 г. связанные волны и т. д. По мнению А. С. Пушкина, т. е. так. «Верно?» — спросил он.", ["В 1973 г. связанные волны и т. д.", "По мнению А. С. Пушкина, т. е. так.", "«Верно?» — спросил он."]),
    ("¿Es estable? «¿Sí?», pregunta la Dra. Ruiz. ¡No!", ["¿Es estable?", "«¿Sí?», pregunta la Dra. Ruiz.", "¡No!"]),
    ("这种微弱的脉冲描述局部的河道。“这稳定吗？”审稿人问道，厚度约为3.3毫米！模型……但是薄的。“数据分离梯度。”我们认为", ["这种微弱的脉冲描述局部的河道。", "“这稳定吗？”审稿人问道，厚度约为3.3毫米！", "模型……但是薄的。", "“数据分离梯度。”", "我们认为"]),
    ("比は３．５であり、核を覆う。この結晶は説明する（流れは記述する。）。「境界を覆う。」と述べた。", ["比は３．５であり、核を覆う。", "この結晶は説明する（流れは記述する。）。", "「境界を覆う。」と述べた。"]),
    ("ठंडा संकेत बदलता है। “क्या यह स्थिर है?” पूछने पर डॉ. ओरवाने ने 2.2 कहा। क्या?", ["ठंडा संकेत बदलता है।", "“क्या यह स्थिर है?” पूछने पर डॉ. ओरवाने ने 2.2 कहा।", "क्या?"]),
    ("ตัวกรองที่อ่อนรบกวนดิน ดร. เวลดรุนกล่าวว่า (x) และ 1.1 มิลลิเมตร สเปกตรัม", ["ตัวกรองที่อ่อนรบกวนดิน", "ดร. เวลดรุนกล่าวว่า (x) และ 1.1 มิลลิเมตร", "สเปกตรัม"]),
    ("No space.The next ... or so it seemed. File.name stays", ["No space.", "The next ... or so it seemed.", "File.name stays"]),
]


@pytest.mark.parametrize("text,want", SPLIT)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_only_the_body_is_prose():
    doc = "% A draft. Yes.\n\\documentclass{article}\n\\title{No. Not.}\n\\begin{document}\n\\maketitle\nYes.\n\\end{document}\nNo."
    assert [doc[a:b] for a, b in sentences.sentences(doc)] == ["Yes."]
    assert sentences.sentences(doc.replace("\\end{document}", ""))[-1] == (len(doc) - 17, len(doc) - 14)
    assert sentences.sentences("") == sentences.sentences("   \n\n ") == sentences.sentences("% only. this.") == []


def test_masks_keep_every_offset(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").collect():
        assert len(sentences.mask(r["text"])) == len(r["text"])
        spans = sentences.sentences(r["text"])
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(r["text"][a:b].strip() == r["text"][a:b] for a, b in spans)


def test_very_long_text_takes_linear_time():
    import time

    for text in ("A short one. " * 60_000, "a" * 500_000, "(" * 3_000 + "a. " * 100, "\\begin{align} " * 3_000, "$" * 20_001, "{" * 20_000, "\\footnote{" * 3_000, "““" * 2_000 + "a. b. " * 200):
        began = time.time()
        sentences.sentences(text)
        assert time.time() - began < 30, text[:20]
