"""Queries on tables unlike the driver's smallest, compared with their SQL."""

import pytest

from pagemill.plans import details  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


def check(spark, folder, name, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/all")
    spark.read.parquet(f"{folder}/all").coalesce(1).toPandas().to_parquet(f"{folder}/pages.parquet")
    compare(spark, str(folder), QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["archive_copies", "image_store"])
def test_pages_of_one_address(spark, tmp_path, name):
    check(spark, tmp_path, name, [(i, f"https://a.org/{i // 20}", "x" * i) for i in range(60)])


def page(n, title, lead, ad="An ad of some words.", more=""):
    return (n, f"https://www.a.example.com/{n}", f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><nav><ul><li><a href="/on">on</a></li></ul></nav><!-- ad {n} --><div class="ad">{ad}</div><article><h1>{title}</h1><p><b>{lead}<br>{more}</article><footer>&copy; a &middot; Foot.</footer></body></html>')


#: A title cut inside a reference, a short article beside a short text, and a line beyond 20,000 characters.
PAGES = [page(0, "The one &amp;&amp;&amp", "The one &amp;&amp;&amp; and " + "more words " * 30), page(1, "A short one.", "A short one of a few words, it is."), page(2, "Long", "long text " * 3000, more=f"<p>{'and more ' * 3000}</p>")]
READ = ["page_blocks", "page_css_extract", "page_flagship", "page_markdown", "page_text_content", "page_xpath_extract"]


@pytest.mark.parametrize("name", READ)
def test_pages_unlike_most(spark, tmp_path, name):
    check(spark, tmp_path, name, PAGES)
