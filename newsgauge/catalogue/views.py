"""Article-shaped views of the given tables.

The tables hold no Chinese text and no outlet names, so the views add them by row number; rules then
fire on every kind of row. The text is SQL both engines accept and serves query and check alike.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from newsgauge.catalogue.registry import table

AS_OF = "2024-03-05T02:30:00"

_OUTLETS = """CASE doc_id % 12 WHEN 0 THEN '新华社' WHEN 1 THEN '北京晚报' WHEN 2 THEN '建筑时报'
    WHEN 3 THEN 'news.cnr.cn' WHEN 4 THEN '未知来源' WHEN 5 THEN source WHEN 6 THEN '小明说'
    WHEN 7 THEN '中建党建' WHEN 8 THEN '某某日报' WHEN 9 THEN '搜狐网' WHEN 10 THEN concat(lang, '.gov.cn')
    ELSE '标题_凤凰网' END"""

ARTICLES = f"""
SELECT doc_id AS ord, lang AS keyword,
  concat(regexp_extract(text, '^[^\\n]*', 0), CASE doc_id % 11 WHEN 0 THEN '项目全面封顶' WHEN 1 THEN '顺利通过验收，全面启用！'
    WHEN 2 THEN '公司招聘公告' WHEN 3 THEN '——最新进展' WHEN 4 THEN '发明专利' WHEN 5 THEN '正式开工' ELSE '' END) AS title,
  concat(CASE WHEN n_chars % 2 = 0 THEN 'http://www.' ELSE 'https://' END,
    CASE n_chars % 7 WHEN 0 THEN 'news.xinhuanet.com' WHEN 1 THEN concat(lang, '.gov.cn')
      WHEN 2 THEN 'news.google.com/rss/articles' ELSE concat(lang, '.example.com') END,
    '/', lang, '/', md5(text),
    CASE doc_id % 4 WHEN 0 THEN '?utm_source=feed' WHEN 1 THEN '?id=7&from=x' WHEN 2 THEN '' ELSE '?id=7' END) AS url,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 5 THEN '5天前'
    ELSE concat('2024-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) END AS date,
  {_OUTLETS} AS media,
  concat(substr(text, length(regexp_extract(text, '^[^\\n]*', 0)) + 2),
    CASE doc_id % 13 WHEN 0 THEN '股票' WHEN 1 THEN '限时秒杀' WHEN 2 THEN '快照' ELSE '' END) AS snippet,
  CASE WHEN doc_id % 3 = 0 THEN 'wechat' ELSE 'news' END AS source
FROM {{documents}}
"""


def sql_view(text: str) -> str:
    """The view as a subquery for the checking engine."""
    return "(" + text.replace("{documents}", "documents").replace("{pages}", "pages") + ")"


ARTICLES_SQL = sql_view(ARTICLES)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARTICLES, documents=table(spark, sf_dir, "documents"))


# --- small lookup tables of the runs -----------------------------------------------------------------

OUTLET_ROWS = ((1, "新华社", "中央级"), (2, "晚报集团", "地方"), (3, "时报", "行业"), (4, "cnr", "央广"))
LABEL_ROWS = (("小明说", "个人账号"), ("搜狐网", "微信公众号"), ("标题_凤凰网", "别的"))
SUBJECT_ROWS = (
    (1, "English desk", ["en"], ["tion", "ing the "]),
    (2, "Bureau", ["fr", "bureau"], ["tre", "que "]),
    (3, "Redaktion Deutschland", ["de"], []),
)


def outlets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTLET_ROWS, "ord int, key string, value string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABEL_ROWS, "media string, category string")


def subjects(spark: SparkSession) -> DataFrame:
    rows = [(*r, "desk", ["2024"]) for r in SUBJECT_ROWS]
    return spark.createDataFrame(
        rows, "ord int, primary string, aliases array<string>, terms array<string>, type string, years array<string>"
    )


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _value(x) -> str:
    if isinstance(x, str):
        return quote(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_value, x)) + "]::VARCHAR[]"
    return str(x)


def sql_rows(rows, columns: str) -> str:
    """Constant rows as a subquery for the checking engine."""
    body = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


@functools.cache
def sql_array(words: tuple) -> str:
    return "[" + ", ".join(map(quote, words)) + "]"
