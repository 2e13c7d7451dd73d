import pytest

from tagloom.deploy import ship
from tagloom.operators import parse
from tagloom.operators import relational as R
from tagloom.plans import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, same_as_sql):
    frame = registry.QUERIES[name](ship(spark), SMALL)
    if name in registry.ORACLE_SQL:
        same_as_sql(frame, registry.ORACLE_SQL[name])
    else:
        assert frame.count() > 0


def _given(frame, path, name):
    """The rows as the only table of a folder."""
    frame.coalesce(1).write.parquet(str(path / "made"))
    next((path / "made").glob("*.parquet")).rename(path / f"{name}.parquet")
    return str(path)


def test_slices_of_short_texts(spark, same_as_sql, tmp_path):
    texts = ["É.", "aé", "€", "a", "ab", "abc", "éab", "aéb", "😀", "", "x y z w", None]
    sf_dir = _given(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    frame = registry.string_slices(ship(spark), sf_dir)
    assert frame.where("doc_id = 0").first()["head"] == "É."
    same_as_sql(frame, registry.ORACLE_SQL["string_slices"], sf_dir)


@pytest.mark.parametrize("name", ["html_rawtext", "html_nearest_section", "html_link_sets"])
def test_pages_are_parsed_once(name, spark):
    plan = registry.QUERIES[name](ship(spark), SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_first_script_and_style_of_any_page(spark, same_as_sql, tmp_path):
    pages = ["<p>no script", "<style>a{}</style><p>x", "<script>1</script><script>2</script>", "<style></style><script>x</script><style>b</style>", ""]
    sf_dir = _given(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), tmp_path, "pages")
    same_as_sql(registry.html_rawtext(ship(spark), sf_dir), registry.ORACLE_SQL["html_rawtext"], sf_dir)


def test_link_sets_and_nearest_sections(spark, tmp_path):
    pages = ["<a href=x>1</a><a>2</a>", "<article><a href=x><svg><a href=s></a></svg></a><nav><section></section><a href=y></a></nav></article>", "<a href=z></a>", "<frameset>"]
    given = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    sf_dir = _given(given, tmp_path, "pages")
    sets = registry.html_link_sets(ship(spark), sf_dir).collect()
    assert sorted((r["kind"], str(r["href"])) for r in sets) == [("both", "x"), ("even only", "None"), ("even only", "z"), ("odd only", "s"), ("odd only", "y")]
    near = registry.html_nearest_section(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in near) == [(0, "body", 2), (1, "article", 1), (1, "nav", 1), (2, "body", 1)]
    nodes = parse.nodes(parse.parse_html(given, "page_id", "html"), "page_id")  # the operators for node tables find the same
    joined = R.nearest_ancestor(R.elements(nodes, "a"), R.elements(nodes, "nav", "article", "section", "body"), "page_id").groupBy("page_id", "outer_local").count()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, near))
    texts = R.text_of(R.elements(nodes, "a"), nodes, "page_id").where("page_id = 0").orderBy("node_id")
    assert [r["text"] for r in texts.collect()] == ["1", "2"]
