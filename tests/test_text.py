import pytest
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.functions import vectors as vx
from loreworks.operators.context import count_tokens, longest_prefix


def one(spark, expr, **cols):
    row = {k: v for k, v in cols.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("a/b.MD", "markdown"), ("x.tsx", "code"), ("n.rst", "text"), ("c/tsconfig.json", "config"), ("p.PDF", "pdf"),
        ("Dockerfile.relay", "config"), ("Makefile", "config"), (".gitignore", None), ("bin/tool", None), ("a.tar.gz", None),
    ],
)
def test_content_kind(spark, path, kind):
    assert one(spark, tx.content_kind(F.col("p")), p=path) == kind


def test_provenance(spark):
    def p(path, kind, project="X"):
        return one(spark, tx.provenance(F.col("a"), F.col("k"), F.col("r"), "HOME"), a=path, k=kind, r=project)

    assert p("x/vendor/a.py", "code") == "local_foreign"
    assert p("x/vendors/a.py", "code") == "local_owned"
    assert p("x/AGENTS.md", "markdown") == "local_foreign"
    assert p("x/AGENTS.md", "markdown", "HOME") == "local_owned"
    assert p("a.pdf", "pdf") == "local_foreign"


def test_tokens_and_identifiers(spark):
    assert one(spark, tx.lex_tokens(F.col("s")), s="entitlementGuard MAX_YAML токен") == [
        "entitlementguard", "entitlement", "guard", "max_yaml", "max", "yaml", "max", "yaml", "токен",
    ]
    assert one(spark, tx.identifiers(F.col("s")), s="HTTPServer plain entitlementGuard") == [
        "HTTPServer", "HTTP", "Server", "entitlementGuard", "entitlement", "Guard",
    ]


def test_token_estimates(spark):
    for s in ["", "hello world", "привет мир", "漢字かな", "a b c d e f g", "!!!! ----", "mixed текст 漢 1 2"]:
        assert one(spark, tx.estimate_tokens(F.col("s")), s=s) == count_tokens(s)
    assert one(spark, tx.approx_tokens(F.col("s")), s="x" * 9) == 2  # 2.5 rounds to even
    assert one(spark, tx.approx_tokens(F.col("s")), s="") == 1


def test_links_stems_goals(spark):
    assert one(spark, tx.link_targets(F.col("s")), s="[[a#b]] [[a|c]] [[dir/x.md]] [[a]] [b]") == ["a", "dir/x.md"]
    assert one(spark, tx.path_stem(F.col("s")), s=" Dir/File.Name.md ") == "file.name"
    assert one(spark, tx.goal_signature(F.col("s"), F.col("p")), s="Fix the auth tests, fix!", p="Web") == "web:auth fix tests"


def test_durations(spark):
    got = spark.sql("SELECT * FROM VALUES (12.9D), (252.0D), (5400.0D), (-3.0D) t(s)").select(
        tx.human_duration(F.col("s")), tx.elapsed_label(F.col("s"))
    ).collect()
    assert [tuple(r) for r in got][:3] == [("12s", "13s"), ("4m", "4m12s"), ("1.5h", "1h30m")]
    assert got[3][1] == "0s"


def test_truncate_then_normalise(spark):
    df = spark.sql("SELECT array(3.0F, 4.0F, 100.0F) AS v, array(0.0F, 0.0F) AS z")
    r = df.select(vx.truncate_normalise(F.col("v"), 2).alias("a"), vx.normalise(F.col("z")).alias("b")).first()
    assert [round(x, 6) for x in r["a"]] == [0.6, 0.8]
    assert r["b"] == [0.0, 0.0]


def test_longest_prefix_marks_a_cut():
    text = "word " * 200
    head = longest_prefix(text, 50)
    assert head.endswith(" […]") and count_tokens(head[: -len(" […]")]) <= 46
    assert longest_prefix("short", 50) == "short"
    assert longest_prefix("anything", 4) == ""
