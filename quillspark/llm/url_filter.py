"""URL filter by a character language-model ratio (operator 2, native).

Rules decide some URLs. Those they allow and those they block train two character models; the rest
is judged by the difference of the two log-likelihoods per character, against a threshold that is
calibrated on rule-decided URLs kept out of the training.

The models are variable-order Markov models with Witten-Bell smoothing: every order from ``order``
down to single characters is blended, P_k(c|h) = (n(hc) + T(h) P_{k-1}(c|h')) / (n(h) + T(h)),
T(h) being the number of different characters seen after h. The query reads whole URLs as they are;
``form`` may fold them first (``form_of``: lower case, from the host on, runs of digits as one ``0``).
Each different form counts once, so repeated URLs do not decide the models.

Everything works on distinct forms and distinct n-grams: one explode of the forms, grouped counts,
windows over contexts (at most one row per character in each), and joins of n-gram tables by their
suffix. Joins that meet hot n-grams are salted, as are forms that more than ``HOT_ROWS`` pages share.

Nulls and odd cases: a null url, or one without ``://``, has empty host and path; a null url is the
empty form. With no allowed or no blocked URL to learn from, every score is 0 and the threshold 0,
so all are allowed. Repeated rows are judged each; null ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread, table

START, END = "\x02", "\x03"
SALTS = 16
HOT_ROWS = 10_000
MAX_SCORE = 20.0
BIN = 0.01


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def form_of(url: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*?://", "")
    return F.regexp_replace(F.translate(F.lower(rest), START + END, "  "), "[0-9]+", "0")


def whole_url(url: Column) -> Column:
    """The URL with all of its characters; only the two that mark its ends in the models are read as spaces."""
    return F.translate(F.coalesce(url, F.lit("")), START + END, "  ")


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule whose host is the url's or a parent of it, and
    whose path the url's starts with."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def grams(forms: DataFrame, order: int) -> DataFrame:
    """One row per character of ``forms.form`` and its end: ``gram``, the character after its ``order - 1`` predecessors."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("form"), F.lit(END))
    return forms.withColumn("_padded", padded).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("form") + 1))).withColumn("gram", F.substring(F.col("_padded"), F.col("_at"), F.lit(order))).drop("_padded", "_at")


def ratio_table(counted: DataFrame, order: int) -> DataFrame:
    """``counted(gram, n_allow, n_block)`` of the longest order -> ``(gram, ratio)``: ln P_allow - ln P_block."""
    levels = {order: counted}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    lower = None
    for k in range(1, order + 1):
        context = Window.partitionBy(F.expr(f"left(gram, {k - 1})"))
        level = levels[k]
        if lower is None:
            level = level.withColumn("p_allow", 1.0 / (F.count("*").over(context) + 1)).withColumn("p_block", F.col("p_allow"))
        else:
            level = level.withColumn("tail", F.expr(f"right(gram, {k - 1})")).join(lower, "tail").drop("tail")
        for side in ("allow", "block"):
            seen, types = F.sum(f"n_{side}").over(context), F.sum((F.col(f"n_{side}") > 0).cast("int")).over(context)
            level = level.withColumn("_seen", seen).withColumn("_types", types)
            blend = (F.col(f"n_{side}") + F.col("_types") * F.col(f"p_{side}")) / (F.col("_seen") + F.col("_types"))
            level = level.withColumn(f"p_{side}", F.when(F.col("_seen") > 0, blend).otherwise(F.col(f"p_{side}"))).drop("_seen", "_types")
        lower = level.select(F.col("gram").alias("tail"), "p_allow", "p_block")
    return lower.select(F.col("tail").alias("gram"), (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def form_scores(forms: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """``(form, score)``: the mean log ratio per character."""
    rows = grams(forms.select("form"), order).withColumn("_salt", F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int"))
    return rows.join(spread(ratios, SALTS), ["gram", "_salt"]).groupBy("form").agg((F.sum("ratio") / F.count("*")).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold on ``(score, label)`` with the largest difference of the shares of allowed and of
    blocked URLs that reach it; 0 unless both labels occur. Scores are counted in bins of fixed number."""
    place = F.floor(F.greatest(F.least("score", F.lit(MAX_SCORE)), F.lit(-MAX_SCORE)) / BIN)
    is_label = lambda name: F.sum((F.col("label") == name).cast("long"))
    bins = scored.groupBy(place.alias("bin")).agg(is_label("allow").alias("allow"), is_label("block").alias("block"))
    above, whole = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    share = lambda name: F.sum(name).over(above) / F.sum(name).over(whole)
    both = (F.sum("allow").over(whole) > 0) & (F.sum("block").over(whole) > 0)
    best = (
        bins.withColumn("both", both)
        .where("both or both is null")
        .withColumn("gain", F.when(both, share("allow") - share("block")))
        .where("gain is not null")
        .agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.abs("bin")).alias("near"), F.col("bin").alias("bin"))).alias("b"))
        .first()
    )
    return 0.0 if best is None or best["b"] is None else best["b"]["bin"] * BIN


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, order: int = 5, held_out: int = 5, form: Callable[[Column], Column] = form_of) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, score). ``score`` is null where a rule decides.

    One form in ``held_out`` of the rule-decided ones calibrates the threshold, the others train."""
    url = F.col(url_col)
    rows = ruled(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), form(url).alias("form")), rules)
    forms = cut(
        rows.groupBy("form", "rule_verdict")
        .agg(F.count("*").alias("n"))
        .groupBy("form")
        .agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("block"), F.max(F.col("rule_verdict").isNull()).alias("open"), F.sum("n").alias("n")),
        "forms",
    )
    forms = forms.withColumn("fold", F.pmod(F.xxhash64("form", F.lit("fold")), F.lit(held_out)))
    trains = F.col("fold") != 0
    n = lambda side: F.sum(F.when(trains, F.coalesce(F.col(side), F.lit(0))).otherwise(0)).alias(f"n_{side}")
    counted = cut(grams(forms.select("form", "fold", "allow", "block"), order).groupBy("gram").agg(n("allow"), n("block")), "grams")
    trained = forms.where(trains).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if trained["allow"] and trained["block"]:
        scores = cut(form_scores(forms.where("open or fold = 0"), cut(ratio_table(counted, order), "ratios"), order), "scores")
        labelled = scores.join(forms.where("fold = 0 and coalesce(allow, 0) <> coalesce(block, 0)"), "form")
        threshold = calibrate(labelled.select("score", F.when(F.col("allow") == 1, "allow").otherwise("block").alias("label")))
    else:
        scores, threshold = forms.select("form", F.lit(0.0).alias("score")), 0.0
    # at most one form in HOT_ROWS rows is hot; its score is copied for each salt
    hot = F.broadcast(forms.where(F.col("n") > HOT_ROWS).select("form", F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    wanted = scores.join(forms.where("open"), "form", "left_semi").join(hot, "form", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    salted = rows.join(hot, "form", "left").withColumn("_salt", F.pmod(F.xxhash64("page_id"), salts).cast("int")).drop("_salts")
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    decided = salted.join(wanted, ["form", "_salt"], "left")
    return decided.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def op2_url_ratio(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), form=whole_url)
