"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import carried, cut, table, uncarried
from lattica.llm.packing import estimated_tokens

LEVELS = ("domain", "language", "source")
#: Hex digits of the order key that name a leaf's bucket: 4096 buckets for each leaf.
BUCKET_DIGITS = 3
SEED = 17
#: Production weights of the registered query: per language, others count 1.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
#: The token budget in hundredths of the corpus, and how often a document may be taken.
BUDGET_PERCENT, MAX_EPOCHS = 80, 2


def named(c: Column) -> Column:
    """A tree node's name; null and empty count as unknown."""
    return F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(c)


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4; sources without one are of domain unknown."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number.isNull() | (number == ""), F.lit("unknown")).otherwise(F.concat(F.lit("domain"), (F.expr("try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS bigint)") % 4).cast("string")))


def weights_column(name: Column, weights: dict[str, int], other: int = 1) -> Column:
    out = F.lit(other).cast("long")
    for k, w in weights.items():
        out = F.when(name == k, F.lit(w).cast("long")).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's budget among its children: column budget replaces parent_budget.

    nodes: parents, name, cap (tokens the child can give), w (whole-number weight), parent_budget.
    A child's share is parent_budget * w / sum(w); what children of too small a cap leave goes to
    their siblings by weight, again and again.  Closed form: with children ordered by cap / w, the first one
    whose share of what is left is below its cap sets the rate for it and all after it.  Shares round down;
    children of weight 0 get nothing.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("cap").cast("double") / F.col("w")), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    d = nodes.filter(F.col("w") > 0)
    d = d.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    open_ = F.col("cap").cast("decimal(38,0)") * F.col("w_left") > F.col("w").cast("decimal(38,0)") * F.col("left")
    d = d.withColumn("open", open_)
    d = d.withColumn("left", F.max(F.when(F.col("open"), F.col("left"))).over(group)).withColumn("w_left", F.max(F.when(F.col("open"), F.col("w_left"))).over(group))
    share = F.floor(F.col("w").cast("decimal(20,0)") * F.col("left").cast("decimal(18,0)") / F.col("w_left").cast("decimal(18,0)")).cast("long")
    return d.withColumn("budget", F.when(F.col("left").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), share))).drop("left", "w_left", "open", "parent_budget")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int) -> DataFrame:
    """leaves: LEVELS, n (tokens), w_domain, w_language, w_source.  Adds each leaf's budget."""
    caps = leaves.withColumn("cap", F.col("n") * max_epochs)
    down: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.sum("n").alias("n"), F.max(f"w_{level}").alias("w"))
        if down is None:
            total = F.sum("n").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("parent_budget", F.floor(total * budget_percent / 100).cast("long"))
        else:
            nodes = nodes.join(down, parents)
        filled = water_fill(nodes, parents, level)
        down = filled.select(*parents, level, F.col("budget").alias("parent_budget"))
    return filled.select(*LEVELS, "n", "budget")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in the seeded order of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def leaf_cuts(slim: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """For each leaf with a budget: epochs taken whole, and last_key, the last order key of the prefix
    of the next epoch ('' for none).  Documents of equal key go in or stay out together."""
    b = leaves.filter("budget > 0 AND n > 0").select(*LEVELS, F.expr("budget div n").alias("epochs"), F.expr("budget % n").alias("rest"))
    b = cut(b, "mix-budgets")
    keyed = slim.join(b.filter("rest > 0"), list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("key").alias("top"))
    so_far = Window.partitionBy(*LEVELS).orderBy("bucket")
    buckets = buckets.withColumn("upto", F.sum("n").over(so_far))
    edge = buckets.groupBy(*LEVELS).agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("top"))).alias("top"),
    )
    edge = cut(edge, "mix-edges")
    inside = keyed.join(edge.filter("edge IS NOT NULL").select(*LEVELS, "edge", "before"), list(LEVELS)).filter("bucket = edge")
    w = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(w)).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("key"))
    out = b.select(*LEVELS, "epochs").join(edge.select(*LEVELS, "top"), list(LEVELS), "left").join(inside, list(LEVELS), "left")
    return cut(out.select(*LEVELS, "epochs", F.coalesce("key", "top", F.lit("")).alias("last_key")), "mix-cuts")


def mixed(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, language_weights: dict[str, int] | None = None, domain_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source, any others) with columns mix_domain, mix_language, mix_source, mix_tokens, mix_copies.

    Rows that the mix takes not once are left out; mix_copies says how often a row is taken (whole epochs
    plus one, if it is in the prefix of the seeded next epoch).  Names that are null or empty are the node
    "unknown".  Tokens are estimated (a quarter of the bytes); empty and null texts have none: in a leaf with other
    documents they follow their order key; a leaf without any tokens is left out.  Repeated rows share
    a key and are taken or left together.  An empty table gives no rows.

    One narrow copy of the table (no texts) is written; the largest groups are summed before any
    exchange, and only one of a leaf's 4096 buckets is ever ordered.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    own = ("doc_id", "text", "lang", "source")
    tree = carried(docs.withColumn("lattica mix domain", named(domain)), *own)
    tree = tree.select(*own, "_row", F.col("_row").getField("lattica mix domain").alias("mix_domain"), named(F.col("lang")).alias("mix_language"), named(F.col("source")).alias("mix_source"), estimated_tokens(F.col("text")).alias("mix_tokens"))
    slim = cut(tree.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("language"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens")), "mix-slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n"))
    leaves = leaves.withColumns({"w_domain": weights_column(F.col("domain"), domain_weights or {}), "w_language": weights_column(F.col("language"), LANGUAGE_WEIGHTS if language_weights is None else language_weights), "w_source": weights_column(F.col("source"), source_weights or {})})
    cuts = leaf_cuts(slim, leaf_budgets(leaves, budget_percent, max_epochs), seed).select(*(F.col(x).alias(f"mix_{x}") for x in LEVELS), F.col("epochs").alias("mix_epochs"), F.col("last_key").alias("mix_last_key"))
    taken = tree.join(cuts, [f"mix_{x}" for x in LEVELS])
    copies = F.col("mix_epochs") + F.when(order_key(seed, F.col("mix_epochs"), F.col("doc_id")) <= F.col("mix_last_key"), 1).otherwise(0)
    taken = taken.withColumn("mix_copies", copies.cast("long")).filter("mix_copies > 0")
    return uncarried(taken, docs.columns, own, {c: F.col(c) for c in (*(f"mix_{x}" for x in LEVELS), "mix_tokens", "mix_copies")})


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("language"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def _fill_sql(level: str, parents: list[str], source: str) -> str:
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN f_{parents[-1]} USING ({', '.join(parents)})" if parents else ""
    budget = f"f_{parents[-1]}.budget" if parents else f"CAST(floor(sum(sum(n)) OVER () * {BUDGET_PERCENT} / 100) AS BIGINT)"
    keys = ", ".join([*parents, level])
    weight = "CASE language " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in LANGUAGE_WEIGHTS.items()) + " ELSE 1 END" if level == "language" else "1"
    return f"""
n_{level} AS (SELECT {keys}, CAST(sum(n) AS HUGEINT) * {MAX_EPOCHS} AS cap, {weight} AS w{', max(' + budget + ') AS pb' if parents else ', ' + budget + ' AS pb'}
  FROM {source} {join} GROUP BY {keys}),
o_{level} AS (SELECT *, pb - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM n_{level} WINDOW w AS ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level})),
s_{level} AS (SELECT *, max(CASE WHEN cap * wl > w * lft THEN lft END) OVER ({by}) AS l2, max(CASE WHEN cap * wl > w * lft THEN wl END) OVER ({by}) AS w2 FROM o_{level}),
f_{level} AS (SELECT {keys}, CAST(CASE WHEN l2 IS NULL THEN cap ELSE least(cap, (w * l2) // w2) END AS BIGINT) AS budget FROM s_{level}),"""


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' OR source IS NULL THEN 'unknown'
      ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
    coalesce(nullif(lang, ''), 'unknown') AS language, coalesce(nullif(source, ''), 'unknown') AS source,
    CAST(coalesce(ceil(strlen(text) / 4), 0) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY ALL),
{_fill_sql("domain", [], "leaf")}
{_fill_sql("language", ["domain"], "(SELECT * FROM leaf) AS l")}
{_fill_sql("source", ["domain", "language"], "(SELECT * FROM leaf) AS l")}
b AS (SELECT domain, language, source, budget // n AS epochs, budget % n AS rest FROM f_source JOIN leaf USING (domain, language, source) WHERE budget > 0 AND n > 0),
k AS (SELECT d.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM d JOIN b USING (domain, language, source)),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, language, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM u WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
