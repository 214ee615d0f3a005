"""Versions, ranges, arrays and text functions against cases."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import arrays, semver
from marlstone.operators import resolve, text


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "range_, inside, outside",
    [
        ("^1.2.3", ["1.2.3", "1.9.0"], ["1.2.2", "2.0.0"]), ("^0.2.3", ["0.2.3", "0.2.9"], ["0.3.0"]), ("^0.0.3", ["0.0.3"], ["0.0.4"]), ("~1.2.3", ["1.2.9"], ["1.3.0"]),
        ("~1", ["1.0.0", "1.9.9"], ["2.0.0"]), ("1.x", ["1.5.0"], ["2.0.0"]), ("*", ["0.0.1", "9.9.9"], []), ("", ["3.0.0"], []), ("1.2", ["1.2.7"], ["1.3.0"]),
        (">=1.0.0 <2.0.0", ["1.0.0", "1.99.0"], ["2.0.0", "0.9.9"]), ("1.0.0 - 1.4", ["1.0.0", "1.4.9"], ["1.5.0"]), ("^1.0.0 || ^3.0.0", ["1.1.0", "3.2.0"], ["2.0.0"]),
        (">1.2", ["1.3.0"], ["1.2.9"]), ("<=1.2", ["1.2.9"], ["1.3.0"]), ("=1.2.3", ["1.2.3"], ["1.2.4"]), ("v1.2.3", ["1.2.3"], ["1.2.4"]), ("> 1.2.3", ["1.2.4"], ["1.2.3"]),
        ("9007199254740990.x", ["9007199254740990.1.0"], ["1.0.0"]), ("<0.0.0", [], ["0.0.0"]), ("^1.2.3-beta.1", ["1.2.3", "1.3.0"], ["2.0.0"]),
    ],
)
def test_ranges(spark, range_, inside, outside):
    rows = [(v, True) for v in inside] + [(v, False) for v in outside]
    df = spark.createDataFrame(rows, "v string, want boolean").withColumn("got", semver.satisfies(semver.key(F.col("v")), semver.parse_range(F.lit(range_))))
    assert [r for r in df.collect() if r.want != r.got] == []


@pytest.mark.parametrize(
    "requirement, status",
    [
        ("npm:other@1", "UNSUPPORTED_ALIAS"), ("latest", "UNSUPPORTED_TAG"), ("github:a/b", "UNSUPPORTED_GIT"), ("a/b", "UNSUPPORTED_GIT"), ("git+ssh://git@github.com/a/b.git", "UNSUPPORTED_GIT"),
        ("file:../x", "UNSUPPORTED_FILE"), ("https://example.com/x.tgz", "UNSUPPORTED_URL"), ("^1.0.0", None), (None, "INVALID_SPEC"), ("1.2.3.4", "INVALID_SPEC"), ("a\0b", "INVALID_SPEC"),
    ],
)
def test_spec_status(spark, requirement, status):
    assert one(spark, requirement, "string", lambda c: semver.spec_status(F.lit("name"), c)) == status


def test_bad_name(spark):
    assert one(spark, "Bad Name", "string", lambda c: semver.spec_status(c, F.lit("1"))) == "INVALID_PACKAGE_NAME"


def test_classes_of_versions(spark):
    got = {v: one(spark, v, "string", semver.classify) for v in ("1.2.3", "1.2.3-rc.1", "1.2", "01.2.3", "x")}
    assert got == {"1.2.3": "ELIGIBLE", "1.2.3-rc.1": "PRERELEASE_TARGET", "1.2": "INVALID_TARGET_SEMVER", "01.2.3": "INVALID_TARGET_SEMVER", "x": "INVALID_TARGET_SEMVER"}


def test_statuses_in_order(spark):
    looked = resolve.lookups(spark.createDataFrame([("a", "^1.0.0"), ("b", "^9.0.0"), ("c", "1.x")], "declared_name string, requirement string"))
    versions = spark.createDataFrame([("a", "1.0.0"), ("a", "1.4.0"), ("a", "2.0.0-beta.1"), ("b", "1.0.0"), ("c", "1.0.0-alpha")], "name string, version string")
    assert {r.declared_name: (r.status, r.target_version) for r in resolve.resolve(looked, versions).collect()} == {"a": ("RESOLVED", "1.4.0"), "b": ("NO_SATISFYING_VERSION", None), "c": ("NO_ELIGIBLE_TARGET", None)}


def test_ordered_difference_keeps_duplicates(spark):
    df = spark.createDataFrame([([1, 1, 2, 3], [2]), (None, [1]), ([], None)], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(arrays.ordered_difference(F.col("a"), F.col("b"))).collect()] == [[1, 1, 3], None, None]


def test_thirds_make_a_whole_vote(spark):
    rows = spark.createDataFrame([(3,)] * 3, "k int").agg(arrays.votes(F.sum(arrays.scaled_vote(F.col("k")).cast("decimal(38,0)"))).alias("v"))
    assert rows.first()["v"] == 1.0


@pytest.mark.parametrize(
    "reference, url",
    [
        ("git+https://github.com/Own/Repo.git", "https://github.com/Own/Repo"), ("git@github.com:own/repo.git", "https://github.com/own/repo"), ("github:own/repo", "https://github.com/own/repo"),
        ("github.com/own/repo", "https://github.com/own/repo"), ("https://www.github.com/own/repo/tree/main/x", "https://github.com/own/repo"), ("https://github.com/own/repo/other", None),
        ("https://gitlab.com/g/sub/repo/-/issues", "https://gitlab.com/g/sub/repo"), ("https://gitlab.com/g/sub/repo", "https://gitlab.com/g/sub/repo"), ("https://gitlab.com/g", None),
        ("https://example.com/a/b", None), ("https://user:pw@github.com/a/b", None), ("https://github.com:80/a/b", None), ("https://github.com/a/%2e%2e", None), ("", None), (None, None),
        ("https://github.com/a/" + "b" * 300, None), ("https://github.com/a/b?x#y", "https://github.com/a/b"), ("ssh://git@github.com/a/b", "https://github.com/a/b"),
    ],
)
def test_repository_urls(spark, reference, url):
    assert one(spark, reference, "string", text.repository_url) == url


def test_chunks_join_to_the_text(spark):
    doc = "intro\n# One\n" + "word " * 600 + "\nnext line\n```\n# not a heading\n" + "x\n" * 2000 + "```\n## Two\nend"
    rows = text.chunk_markdown(spark.createDataFrame([(1, doc), (2, None), (3, "")], "id long, t string"), "id", "t").orderBy("chunk_id").collect()
    assert "".join(r.text for r in rows) == doc
    assert [r.section for r in rows][:2] == ["", "One"] and rows[-1].section == "Two"


def test_marks_count_utf16(spark):
    df = spark.createDataFrame([("a😀b", "b"), ("abc", "z")], "t string, q string")
    assert [r[0] and (r[0].start, r[0].end) for r in df.select(text.utf16_span(F.col("t"), F.col("q"))).collect()] == [(3, 4), None]


def test_prose(spark):
    assert one(spark, "# Title\n\nSome [link](http://x) and `code`\n```\nblock\n```\n<b>bold</b>", "string", text.prose) == "Title Some link and bold"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("d3", "d3-axis", True), ("lodash", "lodash.pick", True), ("react", "preact", False), ("@babel/core", "@babel/preset-env", True), ("@types/node", "node", True), ("@types/node", "types", False),
        ("parcel", "@parcel/graph", True), ("passport", "@passport-next/passport", False), ("X", "x", True), ("markdown-it", "@ts-stack/markdown", False),
    ],
)
def test_families(spark, a, b, same):
    from marlstone.operators.vectors import same_family

    assert spark.createDataFrame([(a, b)], "a string, b string").select(same_family(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize(
    "name, keywords, plugin",
    [
        ("eslint-plugin-react", None, True), ("css-loader", [], True), ("@sveltejs/adapter-node", None, True), ("eslint-config-airbnb", None, True), ("node-config", None, False), ("plugin", None, False),
        ("markdown-it", ["markdown-it-plugin"], False), ("@unocss/vite", ["vite-plugin"], True), ("x", ["a preset"], True), ("react", ["ui"], False),
    ],
)
def test_plugins(spark, name, keywords, plugin):
    from marlstone.operators.vectors import is_plugin

    assert spark.createDataFrame([(name, keywords)], "n string, k array<string>").select(is_plugin(F.col("n"), F.col("k"))).first()[0] is plugin


def test_chart_domains(spark):
    from marlstone.functions import charts

    rows = spark.createDataFrame([(10.0, 10.0), (0.0, 0.0), (100.0, 5000.0), (1.0, 4.0)], "a double, b double").select(charts.domain(F.col("a"), F.col("b")).alias("d")).select("d", charts.ticks(F.col("d"), 4).alias("t")).collect()
    assert tuple(rows[0].d) == (9.0, 11.0) and tuple(rows[1].d) == (0.0, 1.0) and rows[2].d.hi == pytest.approx(5750.0) or rows[2].d.hi < 5750.0
    assert len(rows[2].t) == 5 and rows[2].t == sorted(rows[2].t) and all(x == int(x) for x in rows[3].t)


def test_versions_are_npm_strict(spark):
    kinds = {
        "1.2.3": "ELIGIBLE", " v1.2.3 ": "ELIGIBLE", "1.2.3+build.01": "ELIGIBLE", "0.0.0": "ELIGIBLE", "1.9007199254740991.0": "ELIGIBLE", "1.2.3-0a": "PRERELEASE_TARGET", "1.2.3-a.0.b-c": "PRERELEASE_TARGET", "1.2.3--": "PRERELEASE_TARGET",
        "=1.2.3": "INVALID_TARGET_SEMVER", "v 1.2.3": "INVALID_TARGET_SEMVER", "1.9007199254740992.0": "INVALID_TARGET_SEMVER", "1.99999999999999999999.0": "INVALID_TARGET_SEMVER", "1.2.3-01": "INVALID_TARGET_SEMVER", "1.2.3-a..b": "INVALID_TARGET_SEMVER",
        "1.2.3-": "INVALID_TARGET_SEMVER", "1.2": "INVALID_TARGET_SEMVER", "01.2.3": "INVALID_TARGET_SEMVER", "1.2.3+": "INVALID_TARGET_SEMVER", "1.2.3+a_b": "INVALID_TARGET_SEMVER", "1.2.3-" + "a" * 251: "INVALID_TARGET_SEMVER", "1.2.3-" + "a" * 250: "PRERELEASE_TARGET", "": "INVALID_TARGET_SEMVER",
    }
    rows = spark.createDataFrame([(k,) for k in kinds], "v string").select("v", semver.classify(F.col("v")).alias("kind")).collect()
    assert {r.v: r.kind for r in rows} == kinds
    bad = ["^99999999999999999999", ">=1.9007199254740992.0", "1.2.3-01", "1.2-beta", "~1.2.3-a..b", "1.2.3.4"]
    good = ["=v1.2.3", ">= 1.2", "1.x", "*", "", "^0.2.3-beta.1", "1.2.3 - 2", "<=1.2.3+b || 5"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "r string").select("r", semver.parse_range(F.col("r")).isNotNull().alias("ok")).collect()
    assert {r.r for r in rows if r.ok} == set(good)


def test_resolution_against_brute_force(spark):
    """One name with many versions and requirements; equal versions by the smaller text."""
    from marlstone.operators import resolve

    versions = [f"{a}.{b}.{c}" for a in range(4) for b in range(4) for c in range(3) if (a * b + c) % 4 != 3] + ["v1.2.0", "2.0.0+b", "2.0.0+a", "3.3.3-rc.1", "bad"]
    asked = [f"{op}{a}.{b}.{c}" for op in ("", "^", "~", ">", ">=", "<", "<=") for a in (0, 1, 2, 9) for b in (0, 2) for c in (0, 1)] + ["*", "", "1", "1.x", "<1 || >=3", "0.1 - 1.2", ">1.1 <2.2", ">2 <1", "^1.0.0-rc.1", "latest"]
    looked = resolve.lookups(spark.createDataFrame([("p", x) for x in asked] + [("none", "*")], "declared_name string, requirement string"))
    got = {(r.declared_name, r.requirement): (r.status, r.target_version) for r in resolve.resolve(looked, spark.createDataFrame([("p", x) for x in versions], "name string, version string")).collect()}
    pairs = spark.createDataFrame([(x, w) for x in asked for w in versions], "r string, v string").where(semver.classify(F.col("v")) == "ELIGIBLE")
    fits = pairs.select("r", "v", semver.key(F.col("v")).alias("key")).where(semver.satisfies(F.col("key"), semver.parse_range(F.col("r")))).collect()
    want = {}
    for r in sorted(sorted(fits, key=lambda r: r.v, reverse=True), key=lambda r: r.key):
        want[r.r] = r.v
    assert {k[1]: t for k, (_, t) in got.items() if t} == want and got["none", "*"] == ("NO_ELIGIBLE_TARGET", None) and got["p", "latest"] == ("UNSUPPORTED_TAG", None) and got["p", ">2 <1"] == ("NO_SATISFYING_VERSION", None)
