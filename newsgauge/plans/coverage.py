"""The whole coverage job over an article table.

Stage order decides results and is kept: the funnel and the score see names and links as found;
links are resolved before subjects compete for a row; outlet names are corrected only on the merged
list, after which the own-account and tier rules run again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.dates import check_range
from newsgauge.functions.text import trim_ws
from newsgauge.functions.urls import canonical_url
from newsgauge.operators import classify, dedup, funnel, keywords as kw, report, score, verify
from newsgauge.operators.joins import attach
from newsgauge.session import cut

DUPLICATE_ELSEWHERE = "owned_elsewhere"


@dataclass
class Dimensions:
    """Lookup tables of a run; all but ``subjects`` may be left out."""

    subjects: DataFrame                       # ord, primary, aliases, terms
    outlets: DataFrame | None = None          # ord, key, value (tier)
    labels: DataFrame | None = None           # media, category
    resolved: DataFrame | None = None         # url, final_url
    pages: DataFrame | None = None            # url, final_url, html; one row per url
    cities: tuple[str, ...] | DataFrame = ()  # names, or a table: city
    outlet_store: str | None = None           # folder that keeps the tiers of outlets between runs


@dataclass
class Settings:
    date_from: str
    date_to: str
    mode: str = "all"
    own_accounts: str = v.OWN_ACCOUNT_PATTERN
    noise_rules: tuple = v.NOISE_RULES
    min_score: int = 0
    link_chars: int | None = None             # compare links by so many characters; None: whole

    def __post_init__(self):
        self.date_from, self.date_to = check_range(self.date_from, self.date_to)


@dataclass
class Report:
    """``rows`` has every in-range article once, with ``status``, ``filter_reason`` and the ``stage``
    that rejected it; the other tables are views of it. Articles that left before the score have none.

    Titles and snippets are read by the funnel and the score only, so the rows go on without them; exports take them
    from the articles, by :meth:`with_texts`.
    """

    rows: DataFrame
    keywords: DataFrame
    articles: DataFrame
    kept: DataFrame = field(init=False)
    filtered: DataFrame = field(init=False)

    def __post_init__(self):
        self.kept = self.rows.where("status = 'kept'").drop("status", "filter_reason", "stage")
        self.filtered = self.rows.where("status = 'filtered'")

    def with_texts(self, rows: DataFrame, columns: tuple[str, ...] = ("title", "snippet")) -> DataFrame:
        """Rows of the report with texts of their articles. Spark broadcasts few rows; else both sides are dealt by ord."""
        texts = self.articles.select(F.col("ord").alias("_ord"), *[F.coalesce(c, F.lit("")).alias(c) for c in columns])
        return texts.join(rows, F.col("_ord") == F.col("ord")).select(*rows.columns, *columns)

    def stats(self) -> DataFrame:
        listed = self.rows.where(F.col("status") != DUPLICATE_ELSEWHERE)
        kept = F.col("status") == "kept"
        shown = listed.select(
            F.when(kept, F.col("category")).alias("category"),
            F.when(kept, F.col("source")).alias("source"),
            F.when(kept, F.col("project")).alias("project"),
            F.col("filter_reason"),
            F.col("status"),
        )
        return report.report_stats(shown, ("category", "source", "project", "filter_reason", "status"))

    def rejected_sample(self, n: int = v.FILTERED_SAMPLE) -> DataFrame:
        """The first rejected rows; :meth:`stats` has the exact totals."""
        return report.rejected_sample(self.filtered, [F.col("ord")], n)

    def by_project(self) -> DataFrame:
        return report.count_by_project(self.keywords, self.kept, self.rows)

    def verification(self) -> DataFrame:
        return verify.verification_stats(self.rows.where("page_check IS NOT NULL"))

    def funnel(self) -> DataFrame:
        return report.funnel_counts(self.rows)

    def unlabelled(self) -> DataFrame:
        """Outlets of kept articles that no rule has placed and no label, valid or not, was given for."""
        return classify.unlabelled_outlets(self.kept.select("media", "category", "labelled").distinct())

    def ranked(self) -> DataFrame:
        return report.with_rank(self.kept)


def _reject(df: DataFrame, when: Column, reason: str, stage: str = "final") -> DataFrame:
    """Set a reason, and the stage that gives it, on rows that have none yet."""
    return df.withColumns({
        "stage": F.coalesce("stage", F.when(F.col("filter_reason").isNull() & when, stage)),
        "filter_reason": F.coalesce("filter_reason", F.when(when, reason)),
    })


def _entered(articles: DataFrame) -> DataFrame:
    """Articles with trimmed keywords, and without NULLs in the texts that the rules read."""
    return articles.withColumns({
        "keyword": trim_ws(F.col("keyword")),
        **{c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "media", "snippet", "url")},
    })


def unrequested_articles(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """Articles whose keyword is none of the request's (blanks around either do not count)."""
    asked = kw.clean_keywords(keywords).select(F.col("keyword").alias("_asked"))
    named = articles.withColumn("_keyword", F.coalesce(trim_ws(F.col("keyword")), F.lit("")))
    return named.join(asked, F.col("_keyword") == F.col("_asked"), "left_anti").drop("_keyword")


def _finalise(df: DataFrame, dims: Dimensions, settings: Settings) -> DataFrame:
    """Own-account rule, tier, personal-account rule."""
    df = classify.with_category(df, "ord", dims.outlets, dims.cities, dims.labels, labelled=True, store=dims.outlet_store)
    df = _reject(df, funnel.own_account(F.col("media"), settings.own_accounts), v.REASON_OWN)
    return _reject(df, F.col("category") == v.PERSONAL, v.REASON_PERSONAL)


def _scored(articles: DataFrame, terms: DataFrame, settings: Settings) -> DataFrame:
    """The only stage that reads texts: funnel and score of each article, without title and snippet."""
    found = articles if settings.mode == "all" else articles.where(F.col("source") == settings.mode)
    found = _entered(found)
    found = found.where(funnel.in_date_range(F.col("date"), settings.date_from, settings.date_to))
    rows = attach(found, terms, "keyword", "ord", how="inner")
    rows = rows.withColumn("filter_reason", funnel.funnel_reason(settings.own_accounts, settings.noise_rules))
    precision = F.col("filter_reason") == v.REASON_PRECISION
    rows = rows.withColumn("stage", F.when(precision, "precision").when(F.col("filter_reason").isNotNull(), "content"))
    # a text that left the funnel is not scored: NULLs end its rules at once
    live = F.col("filter_reason").isNull()
    rows = score.with_score(rows.withColumns({c: F.when(live, F.col(c)) for c in ("title", "snippet")}))
    rows = rows.withColumns({c: F.when(live, F.col(c)) for c in ("score", "score_detail")})
    return rows.drop("match_terms", "co_occur", "title", "snippet")


def coverage_report(articles: DataFrame, keywords: DataFrame, dims: Dimensions, settings: Settings) -> Report:
    """Run the job.

    ``articles``: ord (unique LONG, first-wins order), keyword, title, url, date, media, snippet,
    source. ``keywords``: keyword, keyword_rank. Texts are read once, where they are scanned; the narrow rows are written
    to the checkpoint folder then, and once more as the result.
    """
    planned = kw.plan_searches(kw.resolve_keywords(kw.clean_keywords(keywords), dims.subjects))
    terms = planned.select("keyword", "keyword_rank", "project", "match_terms", "co_occur")
    rows = cut(_scored(articles, terms, settings))

    off_topic = rows.where(F.col("filter_reason").isNotNull())
    # rows still in the funnel compete for a link, and the score of the first of each link counts
    rows = dedup.flag_first(rows.where(F.col("filter_reason").isNull()), [F.col("keyword"), canonical_url(F.col("url"))], [F.col("ord")], "ord")
    rows = _reject(rows, ~F.col("is_first"), v.REASON_DUPLICATE, "dedup")
    rows = rows.withColumns({c: F.when(F.col("is_first"), F.col(c)) for c in ("score", "score_detail")}).drop("is_first")
    rows = _reject(rows, F.col("score") < settings.min_score, v.REASON_SCORE, "score")
    # the score has seen the links as found; from here on they are resolved, on rejected rows too
    dropped = off_topic.unionByName(rows.where(F.col("filter_reason").isNotNull()))
    live = rows.where(F.col("filter_reason").isNull())
    if dims.resolved is not None:
        targets = cut(verify.redirect_targets(dims.resolved))
        dropped, live = (verify.replace_links(df, targets) for df in (dropped, live))
    live = _finalise(live, dims, settings)

    # rows rejected by now are out; the others compete for a link across subjects
    rejected = F.col("filter_reason").isNotNull()
    owner_order = [F.col("keyword_rank"), *report.report_order()]
    live = dedup.flag_first(live, [dedup.url_prefix(F.col("url"), settings.link_chars)], owner_order, "ord", "is_owner", ~rejected)
    live = cut(verify.clean_links(live))
    others = live.where(~F.col("is_owner")).drop("is_owner")
    merged = live.where("is_owner").drop("is_owner", "category", "labelled")

    merged = verify.flag_page_checks(verify.correct_by_domain(merged))
    if dims.pages is None:
        merged = merged.withColumn(
            "page_result", F.when(F.col("page_check"), F.lit("skipped"))
        )
    else:
        merged = verify.correct_by_page(merged, dims.pages)
    merged = _finalise(merged, dims, settings)

    parts = [merged.withColumn("status", F.when(rejected, "filtered").otherwise("kept")),
             others.withColumn("status", F.when(rejected, "filtered").otherwise(DUPLICATE_ELSEWHERE)),
             verify.clean_links(dropped).withColumn("status", F.lit("filtered"))]
    return Report(cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)), planned, articles)
