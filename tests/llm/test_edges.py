"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from pricewright.llm import code_search, language_id, near_dedup, packing, pieces, repeats, secret_scan, token_counts, toxicity, vector_dedup

CLASH = ("node", "key", "keys", "bin", "chunk", "rank", "hit_id", "held", "score", "turn", "label", "count", "signature", "component", "copy_node", "first_id", "kept_id", "found", "asked", "starts", "uid", "unit")
LONG = "alpha beta gamma delta " * 9000
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "the quick brown fox jumps over the lazy dog " * 8), (5, "the quick brown fox jumps over the lazy dog " * 8),
    (6, "the quick brown fox jumps over the lazy dog " * 8), (7, LONG), (None, "a text without an id, long enough to have shingles"), (None, None), (8, "🦊 東京 ß İ <|endoftext|>"),
]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def labels(spark):
    return spark.createDataFrame([(i, None, i % 2) for i in range(9)] + [(5, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d),
    "pieces": lambda s, d: pieces.decode(pieces.encode(d)),
    "counts": lambda s, d: token_counts.count_tokens(d, "byte_bpe_50k.json"),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learned(d, labels(s))),
    "repeats": lambda s, d: repeats.without_repeats(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "language": lambda s, d: language_id.predict(d, language_id.counted(language_id.sampled(d, 10))),
    "secrets": lambda s, d: secret_scan.redact(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept(spark, name):
    got = OPERATORS[name](spark, frame(spark)).collect()
    if name == "packing":
        got = [r for r in got if r.start == 0]
    assert len(got) == len(ROWS)
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark).limit(0)).collect() == []


def test_values_of_edges(spark):
    d = frame(spark)
    near = {r.doc_id: r for r in near_dedup.near_duplicates(d).where("doc_id IS NOT NULL").collect()}
    assert near[1].n_shingles == near[2].n_shingles == near[3].n_shingles == 0 and near[3].component_id == 3
    assert near[4].n_shingles == 1 and near[6].component_id == 5 and not near[6].kept and near[5].kept
    lang = {r.doc_id: r for r in OPERATORS["language"](spark, d).collect()}
    assert lang[1].lang_pred == lang[2].lang_pred == lang[3].lang_pred == "und" and lang[4].lang_pred == "en"
    left = {r.doc_id: r for r in repeats.without_repeats(d).collect()}
    assert left[5].text == left[6].text == left[7].text == "" and left[4].text == "one two"
    scores = [r.score for r in OPERATORS["toxicity"](spark, d).collect()]
    assert all(0 <= s <= 1 and not math.isnan(s) for s in scores)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in CLASH if c != "label"})


def test_vectors(spark):
    a = [1.0, 0.0, 0.5]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, a, None), (9, [1.0, 0.0], 1), (None, a, 1), (2, a, 1), (10, [], 1)]
    got = vector_dedup.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    linked = [r for r in got if r.n_links]
    assert len(linked) == 4 and {r.n_links for r in linked} == {3} and {r.component_id for r in linked} == {1}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vector_dedup.near_vectors(vectors(spark, rows).limit(0)).collect() == []


def test_codes(spark):
    v = [1.0, -1.0] * 32
    rows = [(0, v, 1), (20, v, 1), (3, [-x for x in v], None), (4, None, 1), (5, v[:10], 1), (3, v, 1), (None, v, 1)]
    data = code_search.codes(vectors(spark, rows)).where("vec_id IS NOT NULL")
    got = code_search.search(data, data.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.distance) for r in got] == [(0, 3, 0), (0, 20, 0), (0, 3, 64), (20, 0, 0), (20, 3, 0), (20, 3, 64)]
    assert code_search.search(data.limit(0), data.limit(0)).collect() == []
