import zlib

import corpus_pipeline as P
import pytest

from footfall.llm import queries
from footfall.llm._store import cut

from .helpers import ALNUM, corpus, words
from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as classes
from .test_quality_rules import measured

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs, _ = cut(stage(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "source_mix"]
    assert all(tuple(df.columns) == P.COLUMNS for df in stages[:-1])


def test_language_stage_keeps_what_has_letters(spark, stages):
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(rows(stages[0])) == sorted(r for r in docs if any(c.isalpha() for c in r[1] or ""))


def test_language_stage_without_much_to_learn_from(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(i, t, None, "s1", 0) for i, t in enumerate(["a word", "é", " 12 !!", "", None])] + [(None, "a word", None, "s1", 0)]
    assert sorted(rows(P.identify_language(spark, spark.createDataFrame(odd, schema), SF))) == odd[:2]
    few = [(i, f"a word {i}", "en", "s1", 0) for i in range(100, 120) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    got = rows(P.identify_language(spark, spark.createDataFrame(odd + few, schema), SF))
    assert sorted(got) == [(i, t, "en", "s1", 0) for i, t, *_ in odd[:2] + few]


def test_quality_stage(stages):
    before, after = rows(stages[0]), {r[0] for r in rows(stages[1])}
    failed = {i for i, t, *_ in before if (m := measured(t))[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert not failed & after and len(after) > 0.9 * (len(before) - len(failed)) - 60


def test_dedup_stage(stages):
    want = {i for i, (_, c) in classes(rows(stages[1])).items() if i == c}
    assert {r[0] for r in rows(stages[2])} == want


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = contaminated(rows(stages[2]), items)
    assert {r[0] for r in rows(stages[3])} == {i for i, v in found.items() if not v[3]}


def test_mix_stage_covers_the_rest(stages):
    assert {r.doc_id: r.size for r in stages[4].collect()} == {i: len(words(t)) for i, t, *_ in rows(stages[3])}
    assert ALNUM.findall("a b")


def test_run_and_odd_rows(spark, stages, tmp_path):
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "taken").collect())) == sorted(map(tuple, stages[4].select("doc_id", "taken").collect()))
    odd = corpus(40)
    spark.createDataFrame(odd + odd[:3] + [(None, "a b", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert len(out) == len({r.doc_id for r in out}) > 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
