"""Every operator and stage over the odd rows, and over none."""

import collections

import pytest

import corpus_pipeline
from quern.llm import bpe, decontaminate, line_dedup, minhash, quality_model, quality_rules, secrets, sharding, substrings, url_filters
from quern.llm.queries import vocabulary
from tests.llm import cases

PATH = vocabulary()


def bench(spark):
    return spark.createDataFrame([(1, "negative id of the text"), (2, None), (3, ""), (3, "zzz")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (8, None)], "doc_id bigint, quality int")


PER_ROW = {
    "model": lambda s, d: quality_model.classify(d, labels(s)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "rules": lambda s, d: quality_rules.measure(d),
    "bpe": lambda s, d: bpe.encode(d, PATH, outputs=tuple(bpe.OUTPUTS)),
    "lines": lambda s, d: line_dedup.dedup(d),
    "secrets": lambda s, d: secrets.scan(d),
    "substrings": lambda s, d: substrings.remove_repeats(d, outputs=tuple(substrings.OUTPUTS)),
    "shards": lambda s, d: sharding.assign(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_result_a_row(spark, name):
    got = PER_ROW[name](spark, cases.docs(spark))
    ids = sorted((r.doc_id for r in got.select("doc_id").collect()), key=repr)
    assert ids == sorted((r[0] for r in cases.rows()), key=repr)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, cases.empty(spark)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_odd_rows(spark, tmp_path, stage):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    f = corpus_pipeline.STAGES[stage][1]
    for d in (cases.docs(spark), cases.empty(spark)):
        got = f(spark, d, str(tmp_path))
        found = got.collect()
        if stage < 4:
            assert got.columns == d.columns
            assert [x.dataType for x in got.schema] == [x.dataType for x in d.schema]
            assert not collections.Counter(untouched(r) for r in found) - collections.Counter(untouched(r) for r in d.collect())


def untouched(row):
    return tuple(v for c, v in row.asDict().items() if c not in ("text", "n_chars"))


def test_line_stage_keeps_all_documents(spark):
    d = cases.docs(spark)
    got = line_dedup.deduplicate(d).collect()
    assert collections.Counter(map(untouched, got)) == collections.Counter(map(untouched, d.collect()))
    least = {r.doc_id: r.text for r in got}[-(1 << 63)]
    assert least == "the least id of all\nand a line of it that comes twice"


def test_redaction_and_shards_bear_odd_rows(spark, tmp_path):
    d = cases.docs(spark)
    hidden = secrets.redact(d).collect()
    assert collections.Counter(map(untouched, hidden)) == collections.Counter(map(untouched, d.collect()))
    assert {r.doc_id: r.text for r in hidden}[12] == "<|endoftext|> [SECRET]' [SECRET]"  # the closing quote is no part of the match
    assert secrets.redact(cases.empty(spark)).count() == 0
    name = sharding.write_shards(d, str(tmp_path / "out"), shards=3)
    assert name == "shard__"
    assert collections.Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*d.columns).collect())) == collections.Counter(map(tuple, d.collect()))
    sharding.write_shards(cases.empty(spark), str(tmp_path / "none"))


def test_benchmark_edges(spark):
    d = cases.docs(spark)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, bench(spark)).collect()} == {(-5, 1)}
    assert decontaminate.matches(d, bench(spark).limit(0)).count() == 0
    assert decontaminate.clean(d, bench(spark)).count() == d.count() - 1


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (1, "http://A.Example.ORG/es/x?q"), (2, None), (3, "no scheme"), (None, "https://example.org"), (4, "https://example.org/en/12#t"), (5, "x://b.com/de/"), (6, "x://notexample.org/es/"), (7, "://org/a")]
    u = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, host string, path string")
    got = [(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(u, url_filters.rule_table(spark)).collect()]
    assert set(got) == {
        ("1", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("2", "", "", None, "allow"),
        ("3", "", "", None, "allow"),
        ("None", "example.org", "", None, "allow"),
        ("4", "example.org", "/en/12", "example.org/en/1", "block"),
        ("5", "b.com", "/de/", "com/de/", "block"),
        ("6", "notexample.org", "/es/", "org/", "allow"),
        ("7", "org", "/a", "org/", "allow"),
    }
    assert len(got) == len(rows)
    bare = {r.page_id: r.verdict for r in url_filters.judge(u, url_filters.rule_table(spark, [("block", "example.org"), ("block", ""), ("block", None)])).collect()}
    assert bare == {1: "block", 2: "allow", 3: "allow", None: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    import quern.llm.url_filters as own

    limit, own.BROADCAST_RULES = own.BROADCAST_RULES, 2
    try:
        shuffled = [(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in own.judge(u, own.rule_table(spark)).collect()]
    finally:
        own.BROADCAST_RULES = limit
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    assert url_filters.judge(u, url_filters.rule_table(spark, [("block", "x/")]).limit(0)).filter("rule IS NOT NULL").count() == 0
    assert url_filters.judge(u.limit(0), url_filters.rule_table(spark)).count() == 0
