"""Text out of HTML pages: tags, scripts and comments away, blank runs to one, short pieces dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

NOISE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]+>"
# The entities that are turned back.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain(html: Column) -> Column:
    text = F.regexp_replace(html, TAG, " ")
    for entity, mark in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return strip(F.regexp_replace(text, r"\s+", " "))


def page_text(pages: DataFrame, least: int = 50) -> DataFrame:
    """page_id, title, text of pages whose text has more than `least` characters."""
    clean = F.regexp_replace("html", NOISE, " ")
    title = plain(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select("page_id", title.alias("title"), plain(clean).alias("text")).where(F.length("text") > least)


def paragraphs(pages: DataFrame, least: int = 50) -> DataFrame:
    """page_id, place, text of every closed paragraph of more than `least` characters."""
    found = F.regexp_extract_all(F.regexp_replace("html", NOISE, " "), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "raw"))
    return rows.select("page_id", "place", plain(F.col("raw")).alias("text")).where(F.length("text") > least)


def markdown(pages: DataFrame) -> DataFrame:
    """page_id, text: the heading as `# title`, then the paragraphs with a blank line between."""
    body = F.array_join(F.array_sort(F.collect_list(F.struct("place", "text"))).getField("text"), "\n\n")
    parts = paragraphs(pages, 0).groupBy("page_id").agg(body.alias("body"))
    title = plain(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select("page_id", title.alias("title")).join(parts, "page_id").select("page_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("text"))


def _sql_plain(c: str) -> str:
    out = f"regexp_replace({c}, '{TAG}', ' ', 'g')"
    for entity, mark in ENTITIES.items():
        out = f"replace({out}, '{entity}', '{mark.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_CLEAN = f"regexp_replace(html, '{NOISE}', ' ', 'g')"
SQL_TEXT = f"SELECT * FROM (SELECT page_id, {_sql_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {_sql_plain(_CLEAN)} AS text FROM pages) WHERE length(text) > 50"
SQL_PARAGRAPHS = (
    f"WITH r AS (SELECT page_id, regexp_extract_all({_CLEAN}, '(?is)<p[^>]*>(.*?)</p>', 1) AS p FROM pages), "
    "e AS (SELECT page_id, unnest(range(len(p))) AS i, unnest(p) AS raw FROM r) "
    f"SELECT * FROM (SELECT page_id, CAST(i AS INTEGER) AS place, {_sql_plain('raw')} AS text FROM e) WHERE length(text) > 50"
)
