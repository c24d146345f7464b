"""The pipeline's stages against brute force."""

import collections

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from flighttone.llm import languages
from tests.conftest import SMALL
from tests.llm.test_operators import BYTE_BPE, brute_roots, brute_simhash, check_packed, tokenizer

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp long"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Written rows with nulls, copies, near copies and texts without letters."""
    folder = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    text = rows[0][1]
    extra = [
        (9001, None), (9002, ""), (9003, "123 !?"), (9004, text.upper()), (9004, text), (9004, text),
        (9005, text + " end"), (None, text), (None, "the only one of this kind"), (9006, "the the the and of to"),
    ]
    rows += [(i, t, None, "x", 0) for i, t in extra]
    spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def written(spark, docs, tmp_path_factory):
    out, held = {}, docs
    for name, stage in pipeline.STAGES[:-1]:
        folder = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, held, SMALL).write.parquet(folder)
        out[name] = (held, spark.read.parquet(folder))
        held = out[name][1]
    return out


def ids(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_columns(written):
    assert all(tuple(after.columns) == pipeline.COLUMNS for _, after in written.values())


def test_language_stage(written):
    before, after = written["language"]
    expected = collections.Counter({k: n for k, n in ids(before).items() if any(c.isalpha() for c in k[1] or "")})
    assert ids(after) == expected


def test_exact_stage(written):
    before, after = written["exact_dedup"]
    last = {}
    for i, t in ids(before):
        key = t.translate(LOWER)
        last[key] = max(last.get(key, -1), -1 if i is None else i)
    found = collections.Counter((-1 if i is None else i, t.translate(LOWER)) for i, t in ids(after).elements())
    assert found == collections.Counter((i, t) for t, i in last.items())


def test_near_stage(written):
    before, after = written["near_dedup"]
    rows = sorted(ids(before).elements(), key=lambda r: (r[0] is None, r[0] or 0))
    roots = brute_roots([brute_simhash(t) for _, t in rows], 2)
    assert ids(after) == collections.Counter(rows[r] for r in set(roots))


def test_packing_stage(spark, written):
    encode = tokenizer(BYTE_BPE)
    _, kept = written["near_dedup"]
    rows = pipeline.pack(spark, kept, SMALL).collect()
    check_packed(rows, [(i, (*encode(t), 1)) for i, t in ids(kept).elements()])


def test_run(spark):
    rows = pipeline.run(spark, SMALL).collect()
    assert rows and len({r.doc_id for r in rows}) <= 200


def test_stages_of_nothing(spark, docs, tmp_path):
    held = docs.limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, held, SMALL).write.parquet(f"file://{tmp_path}/{name}")
        held = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert held.count() == 0


def test_clean_documents_stay(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = pipeline.language(spark, known, SMALL)
    assert kept.count() == known.filter("text rlike '[a-zA-Z]'").count()
    assert languages.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).pieces


def test_rows_keep_their_number(spark, docs, tmp_path):
    docs.repartition(1).write.parquet(str(tmp_path / "docs"))
    numbered = []
    for size in ("128MB", "4KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = pipeline._numbered(spark.read.parquet(str(tmp_path / "docs"))).collect()
        numbered.append(sorted((r._row, r.doc_id is None, r.doc_id or 0, r.text or "") for r in found))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbered[0] == numbered[1] and len({r[0] for r in numbered[0]}) == docs.count()


def test_tables_without_files(spark):
    rows = [(1, "a b c d", "en", "x", 7), (1, "a b c d", "en", "x", 7), (2, "A b c d", "en", "x", 7), (None, None, None, None, None)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(pipeline.exact_dedup(spark, held, "")) == ids(held.filter("doc_id is null or doc_id = 2"))
    assert ids(pipeline.near_dedup(spark, held, "")) == ids(held.filter("doc_id is null").unionByName(held.filter("doc_id = 1").limit(1)))


def test_a_file_read_twice(spark, docs, tmp_path):
    """Repeated rows are one document, the same for a table with fewer and with other columns."""
    path = str(tmp_path / "docs")
    docs.repartition(2).write.parquet(path)
    once, twice = spark.read.parquet(path), spark.read.parquet(path, path)
    for stage in (pipeline.exact_dedup, pipeline.near_dedup):
        assert ids(stage(spark, twice, "")) == ids(stage(spark, once, ""))


def test_missing_columns(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.select("text", "doc_id", "fp").write.parquet(path)
    held = spark.read.parquet(path)
    for stage in (pipeline.exact_dedup, pipeline.near_dedup):
        assert tuple(stage(spark, held, "").columns) == pipeline.COLUMNS
        assert ids(stage(spark, held, "")) == ids(stage(spark, docs, ""))
    assert pipeline.language(spark, held, "").count() == 0
    assert pipeline.pack(spark, held, "").agg({"length": "sum"}).first()[0] == pipeline.pack(spark, docs, "").agg({"length": "sum"}).first()[0]


def test_unlearned_languages_go(spark):
    """Texts of languages that no labelled row has are dropped, those of learned ones stay."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*pipeline.COLUMNS)
    others = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由在尊严和权利上一律平等", "มนุษย์ทั้งหลายเกิดมามีอิสระ", "ሀለሐመሠረሰሸቀበተ" * 20,
    ]
    more = spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate(others)], known.schema)
    found = pipeline.language(spark, known.unionByName(more), SMALL)
    assert ids(found) == ids(known.filter("text rlike '[a-zA-Z]'"))
