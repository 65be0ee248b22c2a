import pytest

import corpus_pipeline
from tidemark.llm import queries

from .test_text import brute_lines, brute_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"sentence number {i} has words {i * 7} of its own {i * 13}\nand a line that all hold\nk{i}", "en", "s", 80) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 80), (51, None, None, None, None), (52, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_line_stage_equals_brute_force(spark, docs, sf_dir):
    out = corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir)
    assert out.columns == COLUMNS
    gone = {d: n for d, _, n, _ in brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])}
    for r in out.collect():
        assert gone[r["doc_id"]] == 0 or r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in out.collect()} == set(gone)  # the copy keeps its short line


def test_near_stage_equals_brute_force(spark, docs, sf_dir):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert out.columns == COLUMNS and {r["doc_id"] for r in out.collect()} == {i for i, x in want.items() if x[2]}


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = corpus_pipeline.reject_toxic(spark, docs, sf_dir)
    assert rejected.columns == COLUMNS and 0 < rejected.count() <= docs.count()
    mixed = corpus_pipeline.mix_domains(spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id")
    assert good.join(mixed, "doc_id", "left_anti").count() <= 0.03 * good.count()  # clean documents stay
    poor = docs.join(labels.where("quality = 0"), "doc_id")
    assert poor.join(mixed, "doc_id", "left_semi").count() < poor.count()


@pytest.mark.parametrize("n_poor,labelled", [(0, True), (3, True), (0, False)])
def test_mixing_keeps_good_documents_when_poor_ones_are_scarce(spark, tmp_path, n_poor, labelled):
    text = lambda i: " ".join(f"{'junk' if i < n_poor else 'prose'}{(i * 31 + j * j) % 60}" for j in range(50))
    docs = spark.createDataFrame([(i, text(i), "en", "s", 80) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i >= n_poor), 0) for i in range(300 if labelled else 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).collect()}
    assert left >= set(range(n_poor, 300))


CLASHES = ["score", "predicted", "offending", "n_lines", "n_dropped", "_bitmaps", "tag", "kept", "n", "n_tokens", "p", "rate", "copies", "ids", "decoded", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that clash."""
    prose = lambda i: " ".join(f"w{(i * 37 + j * j) % 211}" for j in range(60))
    texts = [(i, prose(i)) for i in range(60)] + [(70, None), (71, ""), (72, " \n\n"), (73, "word " * 26_000), (5, prose(5)), (80, prose(7)), (80, prose(7)), (None, prose(9)), (None, None)]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), *CLASHES) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, i % 4 and 1, int(i % 9 == 0)) for i in range(60)] + [(None, 1, 1), (70, None, None), (1, 0, 1), (999, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_over_odd_rows(spark, odd, odd_dir, name, stage):
    out = stage(spark, odd, odd_dir)
    empty = stage(spark, odd.limit(0), odd_dir)
    assert empty.count() == 0 and empty.columns == out.columns
    rows = [r.asDict() for r in out.collect()]
    ids = [r["doc_id"] for r in rows]
    if name == "byte_bpe":
        assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (70, 71)} == {0}
        return
    assert out.columns == COLUMNS
    assert {70, 71, 72} <= set(ids) and None in ids  # nothing to judge, so they stay
    source = {(r["doc_id"], r["text"]): r for r in odd.collect()}
    if name in ("toxicity", "near_dedup", "mixing"):  # texts and all else as they were
        assert all(r == {c: source[r["doc_id"], r["text"]][c] for c in COLUMNS} for r in rows)
        assert ids.count(5) in (0, 2)  # repeated rows go together
    if name == "near_dedup":
        assert 80 not in ids and 7 in ids and 73 in ids and ids.count(None) == 2
    if name == "line_dedup":
        assert ids.count(5) == 2 and 80 not in ids and 73 in ids
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, duck, same, name):
    same(duck.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas())
