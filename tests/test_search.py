import datetime as dt

import pytest

from quarry.functions.text import deletions, python_tokens
from quarry.operators import index
from quarry.plans import search
from quarry.plans.query import And, Filter, Not, Or, Phrase, Proximity, Term, parse
from quarry.schema import RECORDS


def records(spark, rows):
    """rows: dicts or paths."""
    out = []
    for k, r in enumerate(rows):
        r = {"path": r} if isinstance(r, str) else r
        base = dict(volume=1, node=k + 1, parent_node=None, name=r["path"].rsplit("/", 1)[-1], kind="file", len=0, mode=0, owner=0, group=0, xattrs_digest=0, created=None, modified=None, changed=None, hidden=False, tags=[], finder_comment=None) | r
        out.append(tuple(base[f] for f in ("volume", "node", "parent_node", "path", "name", "kind", "len", "mode", "owner", "group", "xattrs_digest", "created", "modified", "changed", "hidden", "tags", "finder_comment")))
    return spark.createDataFrame(out, RECORDS)


def hits(spark, rows, text, contents=None, limit=50, **options):
    columns = index.record_columns(records(spark, rows))
    postings = index.content_postings(spark.createDataFrame([(1, k, t) for k, t in contents.items()], "volume long, node long, text string")) if contents else None
    return [(r.path, r.score, r.reason) for r in search.ranked(columns, text, postings, limit=limit, as_of="2026-09-01", **options).collect()]


def paths(*args, **options):
    return [p for p, _, _ in hits(*args, **options)]


def test_weights_and_order(spark):
    assert hits(spark, ["/Users/me/Desktop/report.pdf", "/Users/me/report/archive.txt"], "report", substring_fallback="never") == [("/Users/me/Desktop/report.pdf", 1468, "PrefixName"), ("/Users/me/report/archive.txt", 256, "PathComponent")]
    assert hits(spark, [{"path": "/tmp/a.pdf", "name": "report.pdf"}, {"path": "/tmp/b.pdf", "name": "notes.pdf"}], "port") == [("/tmp/a.pdf", 312, "SubstringName")]
    assert [s for _, s, _ in hits(spark, ["/x/alpha.md", "/x/alpha-alpha-alpha.md"], "alpha", substring_fallback="never")] == [1504, 1468]
    assert hits(spark, [{"path": "/tmp/client", "tags": ["client"]}], "client")[0][2] == "ExactName"
    assert [s for _, s, _ in hits(spark, ["/tmp/a/needle", "/tmp/b/needle"], "needle", {1: "needle body text"}, substring_fallback="never")] == [2626, 2468]
    assert hits(spark, ["/Users/me/Desktop/report.pdf"], "report")[0][1] == 1768  # fewer than the limit scored: the name also counts as a substring
    assert hits(spark, ["/Users/me/Desktop/report.pdf"], "report", limit=1)[0][1] == 1468


def test_content_phrases_and_proximity(spark):
    two = ["/tmp/1.txt", "/tmp/2.txt"]
    assert hits(spark, two, '"instant content search"', {1: "an instant content search result", 2: "instant search content result"})[0][::2] == ("/tmp/1.txt", "Content")
    assert len(paths(spark, two, '"client alpha" OR "client beta"', {1: "client alpha phrase", 2: "client beta phrase"})) == 2
    assert paths(spark, two, "near:3:alpha,beta", {1: "alpha one two beta", 2: "alpha one two three four five beta"}) == ["/tmp/1.txt"]
    assert paths(spark, two, "client AND near:2:alpha,beta", {1: "client alpha one beta", 2: "client alpha one two three beta"}) == ["/tmp/1.txt"]


def test_filters(spark):
    rows = [{"path": "/Users/me/Desktop/PLAN.md", "len": 16384}, {"path": "/Users/me/Desktop/PLAN.pdf", "len": 16384}, {"path": "/Users/me/Desktop/tiny.md", "len": 12}, {"path": "/Users/me/Desktop/Docs", "kind": "dir"}]
    assert paths(spark, rows, "kind:file ext:md path:desktop size:>1kb") == ["/Users/me/Desktop/PLAN.md"]
    day = lambda *d: dt.datetime(*d)
    rows = [{"path": "/a/recent.md", "modified": day(2026, 8, 24), "changed": day(2026, 8, 24), "created": day(2026, 8, 1)}, {"path": "/a/old.md", "modified": day(2024, 1, 15), "changed": day(2024, 1, 15), "created": day(2024, 1, 1)}, {"path": "/a/none.md"}]
    assert paths(spark, rows, "ext:md modified:>=2026-01-01") == ["/a/recent.md"]
    assert paths(spark, rows, "ext:md created:<2025-01-01") == ["/a/old.md"]
    assert paths(spark, rows, "ext:md changed:2026-08-24") == ["/a/recent.md"]
    assert "/a/none.md" in paths(spark, rows, "ext:md -modified:>=2026-01-01")
    three = ["/Users/me/Desktop/report.md", "/Users/me/Downloads/report.md", "/Users/me/Documents/report.md"]
    assert paths(spark, three, "report @desktop") == three[:1]
    assert paths(spark, three, "report scope:downloads") == three[1:2]
    assert paths(spark, three, "report scope:/Users/me/Documents") == three[2:]


def test_boolean_algebra(spark):
    rows = ["/tmp/report.md", "/tmp/invoice.md", "/tmp/draft-report.md", "/tmp/notes.md"]
    assert paths(spark, rows, "(report OR invoice) NOT draft") == ["/tmp/invoice.md", "/tmp/report.md"]
    assert paths(spark, ["/t/report.md", "/t/invoice.pdf", "/t/image.png"], "ext:md OR ext:pdf") == ["/t/invoice.pdf", "/t/report.md"]
    work = ["/c/Client Work/final notes.md", "/c/Client Work/draft notes.md"]
    assert paths(spark, work, '"Client Work" notes -draft') == work[:1]
    assert paths(spark, rows, "") == [] and paths(spark, rows, "report", limit=0) == [] and len(paths(spark, rows, "!!!")) == 4
    assert paths(spark, rows, "report", volumes=[]) == []


def test_tags_comments_pins_and_fuzzy(spark):
    rows = [{"path": "/t/report.md", "tags": ["Important", "Client"]}, {"path": "/t/draft.md", "tags": ["Later"]}]
    assert paths(spark, rows, "tag:important") == ["/t/report.md"] and hits(spark, rows, "client")[0][2] == "Tag"
    assert paths(spark, [{"path": "/t/a.md", "finder_comment": "client handoff notes"}], "handoff") == ["/t/a.md"]
    pinned = spark.createDataFrame([(1, 2)], "volume long, node long")
    assert paths(spark, ["/a/report.md", "/b/report.md"], "report", pinned=pinned) == ["/b/report.md", "/a/report.md"]
    assert hits(spark, ["/tmp/needl"], "needle") == [("/tmp/needl", 100, "FuzzyName")]
    assert hits(spark, ["/tmp/quartely-plan.md"], "quarterly")[0][2] == "FuzzyName"
    assert hits(spark, [{"path": "/Volumes/B/report.md", "volume": 2}, "/Volumes/A/report.md"], "report")[0][0] == "/Volumes/A/report.md"


def test_hot_and_deep_batches(spark):
    columns = index.record_columns(records(spark, ["/t/needle.md", "/t/deep.md"]))
    content = spark.createDataFrame([(1, 2, "needle exists only in content")], "volume long, node long, text string")
    hot, deep = search.hot_and_deep(columns, "needle", index.content_postings(content), as_of="2026-09-01")
    assert [r.path for r in hot.collect()] == ["/t/needle.md"]
    assert [(r.path, r.reason) for r in deep.collect()] == [("/t/deep.md", "Content")]
    shown = search.with_snippets(deep, content, "needle", 7).first().snippet
    assert shown.text == "needle exists" and (shown.highlights[0].start, shown.highlights[0].end) == (0, 6)


def test_limit_keeps_the_first_names(spark):
    rows = [f"/t/{k:03}.txt" for k in range(1, 97)]
    assert paths(spark, rows, "alpha beta", {k: "alpha beta body text" for k in range(1, 97)}, limit=3) == rows[:3]


def test_parser():
    q = parse('kind:file ext:md path:desktop -"draft copy" needle')
    assert q.terms == ("needle",) and q.excluded == ("copy", "draft") and len(q.filters) == 3
    assert parse("a b or c").expression == Or((And((Term("a"), Term("b"))), Term("c")))
    assert parse('not "x y"').expression == Not(Phrase("x y")) and parse("(a b").expression is None and parse("a and").expression is None
    assert parse('near:3:b,a').expression == Proximity(3, ("a", "b")) and parse("near:300:a,b").expression != Proximity(300, ("a", "b"))
    assert parse("size:<=2kb").expression == Filter("size", "<=2kb", "<=", 2048) and isinstance(parse("size:xx").expression, And)
    assert parse("b a").key() == parse("b  a").key() != parse("a b c").key()
    assert parse('"open to the end').expression == Phrase("open to the end") and parse("date:2024-02-30").expression.__class__ is And


@pytest.mark.parametrize(("a", "n"), [("ab", 3), ("12345a", 0), ("é", 0), ("abcd", 11)])
def test_deletions(a, n):
    assert len(deletions(a)) == n


def test_tokens():
    assert python_tokens("Plan_v2-åβç É9 x") == ["plan", "v2", "åβç", "é9", "x"]


def test_grams_and_paths(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text as X

    got = [r.g for r in spark.createDataFrame([("ab",), ("abc",), ("abca",), ("åβçå",), ("aaaa",)], "x string").select(X.grams(F.col("x")).alias("g")).collect()]
    assert got == [[], ["abc"], ["abc", "bca"], ["åβç", "βçå"], ["aaa"]]
    row = spark.createDataFrame([("/a/b.tar.gz", "/a/.bashrc", "/a/b.")], "p string, q string, r string").select(*(X.extension(F.col(c)) for c in "pqr"), X.ancestors(F.col("p")), X.renamed(F.col("p"), F.lit("/a"), F.lit("/z")), X.keep_both_name(F.lit("s.txt"), F.lit(2))).first()
    assert list(row) == ["gz", None, "", ["/a"], "/z/b.tar.gz", "s copy 2.txt"]
