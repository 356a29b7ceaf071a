"""URL filters by association rules.

Hand-written rules (host and path prefix, longest wins) decide first. For the
rest, a host that holds a seed word is blocked; seed words are given, not mined.
What is mined is what else the urls of such hosts have in common: Spark's
FP-growth finds combinations of up to three other tokens (words of host and
path, query names) on pages of seeded hosts, all pages are counted against
them, and combinations that imply a block with enough support and confidence
become rules that also reach hosts without a seed word. Each rule is filed
under its rarest token only, so a page meets the few rules filed under its own
tokens, and a common token brings no crowd.

Evidence must not come from one site: a rule needs pages of ``SUPPORT_HOSTS``
hosts, and a quarter of the hosts, chosen by hash, takes no part in mining; a
combination that is not as sure there is dropped. Pages that a hand-written
rule blocks for another reason (its region) count for neither side.

Long urls do not multiply combinations: tokens that occur on the same pages are
one, and a page with more than ``BASKET`` tokens is given to FP-growth in parts
that together hold all its threes. Supports are counted afterwards, so parts
lose none and count none twice.

The support is a number of pages, the same at every size: how many pages show
that a combination is no chance does not depend on the table.

Results for odd input: a url that is null or has no ``://`` has empty host and
path and no tokens, and is allowed; ties between rules of equal length cannot
occur, as a host fits one rule per host suffix and the longer host wins;
repeated pages get equal rows; other columns than page_id and url are not
looked at; no rows give no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwright.session import materialize, sized

# fixed values: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# fixed values: words in host names that mark unwanted sites
SEEDS = ("casino", "bet", "bets", "pills", "spam", "adult", "xxx", "porn", "ads", "track", "loan", "viagra")

SUPPORT_ROWS = 10  # pages of seeded hosts a combination must occur on, however many there are
SUPPORT_HOSTS = 3  # and their hosts
CONFIDENCE = 0.95
BASKET, _GROUP = 12, 4  # tokens of a basket; a longer page is cut into groups, three of which make a basket


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens with their place: suffix and words of the host, path words, query names; digits as ``#``."""
    words = lambda text, pattern, mark: F.transform(
        F.filter(F.split(text, pattern), lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, r"\d+", "#"))
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.regexp_replace(query, r"=[^&]*", "")
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    return F.array_distinct(
        F.concat(
            words(suffix, r"\.", "tld:"),
            words(F.regexp_replace(host, r"\.?[^.]+$", ""), r"[.\-_]", "word:"),
            words(path, r"[/._\-]", "path:"),
            words(names, r"&", "query:"),
        )
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and its verdict, and tokens of every page."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"))
    rows = rows.select("page_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    return rows.select(
        "page_id",
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules).alias("_by"),
        tokens_of(F.col("_url"), F.col("host"), F.col("path")).alias("tokens"),
    )


def seed_labels(rows: DataFrame, seeds=SEEDS) -> DataFrame:
    """``rows`` with ``label``: block for a seed word in the host, null if a hand-written rule blocks, else allow."""
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"word:{s}") for s in seeds]))
    by_hand = F.coalesce(F.col("_by.verdict") == "block", F.lit(False)) | (F.size("tokens") == 0)
    return rows.withColumn("label", F.when(seeded, "block").when(~by_hand, "allow"))


def _baskets(tokens: Column) -> Column:
    """``tokens`` if they are few, else parts of them such that any three share one."""
    n_groups = F.ceil(F.size(tokens) / _GROUP).cast("int")
    group = lambda g: F.slice(tokens, g * _GROUP + 1, _GROUP)
    numbers = F.sequence(F.lit(0), n_groups - 1)
    threes = F.flatten(
        F.transform(
            F.filter(numbers, lambda i: i < n_groups - 2),
            lambda i: F.flatten(
                F.transform(
                    F.filter(numbers, lambda j: (j > i) & (j < n_groups - 1)),
                    lambda j: F.transform(
                        F.filter(numbers, lambda k: k > j), lambda k: F.concat(group(i), group(j), group(k))
                    ),
                )
            ),
        )
    )
    return F.when(F.size(tokens) > BASKET, threes).otherwise(F.array(tokens))


def combinations(rows: DataFrame, support_rows: int = SUPPORT_ROWS) -> DataFrame:
    """(tokens): up to three tokens that FP-growth finds together on enough bad ones of rows (_row, tokens, bad)."""
    each = rows.select("_row", "bad", F.explode("tokens").alias("token"))
    # tokens on the same rows, bad or not, have one signature; the first of them stands for all
    signed = each.groupBy("token").agg(
        F.count_if("bad").alias("often"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("_row").cast("decimal(38,0)")).alias("mark"),
    )
    first = signed.filter(F.col("often") >= support_rows).groupBy("n", "mark").agg(F.min("token").alias("token"))
    frequent = materialize(first.select("token"), "frequent-tokens")
    kept = each.filter("bad").join(frequent, "token").groupBy("_row").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    baskets = materialize(kept.select(F.explode(_baskets(F.col("tokens"))).alias("items")), "url-baskets")
    total = baskets.count()
    if not total:
        return kept.select("tokens").limit(0)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, support_rows / total)).fit(baskets).freqItemsets
    return found.filter(F.size("items") <= 3).select(F.sort_array("items").alias("tokens"))


def mine(
    labelled: DataFrame,
    support_rows: int = SUPPORT_ROWS,
    confidence: float = CONFIDENCE,
    support_hosts: int = SUPPORT_HOSTS,
    seeds=(),
) -> DataFrame:
    """(tokens, confidence, support, hosts): pruned rules for a block, from rows (_row, host, tokens, label).

    A rule that a shorter one implies with no less confidence is dropped.
    """
    words = F.array(*[F.lit(f"word:{s}") for s in seeds]).cast("array<string>")
    rows = labelled.filter(F.col("label").isNotNull()).select(
        "_row",
        "host",
        (F.col("label") == "block").alias("bad"),
        F.array_except("tokens", words).alias("tokens"),
        (F.pmod(F.xxhash64("host"), F.lit(4)) == 0).alias("held"),
    )
    rows = materialize(rows, "labelled-urls")
    found = materialize(filed(combinations(rows.filter(~F.col("held")), support_rows)), "url-combinations")
    each = rows.select("*", F.explode("tokens").alias("_key"))
    met = each.join(sized(found.withColumnRenamed("tokens", "_needs"), "url-combinations"), "_key").filter(
        F.size(F.array_except("_needs", "tokens")) == 0
    )
    learned, held = ~F.col("held"), F.col("held")
    counts = met.groupBy(F.col("_needs").alias("tokens")).agg(
        F.count_if(learned & F.col("bad")).alias("support"),
        F.count_if(learned).alias("n"),
        F.count_if(held & F.col("bad")).alias("held_bad"),
        F.count_if(held).alias("held_n"),
        F.count_distinct(F.when(learned & F.col("bad"), F.col("host"))).alias("hosts"),
    )
    sure = counts.select(
        "tokens", (F.col("support") / F.greatest("n", F.lit(1))).alias("confidence"), "support", "hosts", "held_bad", "held_n"
    ).filter(
        (F.col("support") >= support_rows)
        & (F.col("hosts") >= support_hosts)
        & (F.col("confidence") >= confidence)
        & (F.col("held_bad") >= confidence * F.col("held_n"))
    )
    sure = materialize(sure.drop("held_bad", "held_n"), "url-rules")
    # shorter rules each rule contains: drop one token, or all but one
    size = F.size("tokens")
    part = F.explode(
        F.array_distinct(
            F.concat(
                F.transform("tokens", lambda t: F.array_except("tokens", F.array(t))),
                F.transform("tokens", lambda t: F.array(t)),
            )
        )
    )
    shorter = sure.select(F.col("tokens").alias("_part"), F.col("confidence").alias("_c"))
    implied = (
        sure.filter(size > 1)
        .select("tokens", "confidence", part.alias("_part"))
        .filter(F.size("_part") < size)
        .join(shorter, "_part")
        .filter(F.col("confidence") <= F.col("_c"))
        .select("tokens")
        .distinct()
    )
    return sure.join(implied, "tokens", "left_anti")


def filed(rules: DataFrame) -> DataFrame:
    """``rules`` with ``_key``: the token of each that fewest rules hold."""
    rules = rules.withColumn("_rule", F.sha2(F.array_join("tokens", "\n"), 256))
    each = rules.select("_rule", F.explode("tokens").alias("_key"))
    often = each.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy("_rule").orderBy("_n", "_key")
    key = each.join(often, "_key").withColumn("_at", F.row_number().over(first)).filter("_at = 1")
    return rules.join(key.select("_rule", "_key"), "_rule").drop("_rule")


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, seeded and mined (rules that fit) of every page.

    A page that no hand-written rule fits is blocked if its host holds a seed
    word or a mined rule fits it.
    """
    rows = materialize(
        seed_labels(judged(pages, rules), seeds).withColumn("_row", F.monotonically_increasing_id()), "url-tokens"
    )
    mined = materialize(filed(mine(rows, seeds=seeds)), "url-index")
    open_rows = rows.filter(F.col("_by").isNull()).select("_row", "tokens", F.explode("tokens").alias("_key"))
    fits = (
        open_rows.join(sized(mined.select(F.col("tokens").alias("_needs"), "_key"), "url-index"), "_key")
        .filter(F.size(F.array_except("_needs", "tokens")) == 0)
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("mined"))
    )
    seeded = F.coalesce(F.col("label") == "block", F.lit(False))
    own = F.when(seeded | F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.join(fits, "_row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_by.rule").alias("rule"),
        F.coalesce(F.col("_by.verdict"), own).alias("verdict"),
        seeded.alias("seeded"),
        F.coalesce("mined", F.lit(0)).cast("long").alias("mined"),
    )
