"""Count-based next-event model: an interpolation of two contexts and the base rate.

p(y | h2, h1) = l2 c(h2,y)/c(h2) + l1 c(h1,y)/c(h1) + l0 (c(y)+a)/(N+aV), where h1 is the
last token and h2 the last two. An unseen context passes its weight on to l0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.operators.scale import exact_quantile, few
from lanternflow.session import durable, max_group_rows

P_FLOOR = 1e-9
CONTEXT = ["t2", "t1"]


@dataclass(frozen=True)
class NextEventModel:
    """Stored counts of training triples and of every smaller context."""

    triples: DataFrame   # t2, t1, token_id, c
    contexts: DataFrame  # t2, t1, c2
    pairs: DataFrame     # t1, token_id, c1y
    firsts: DataFrame    # t1, c1
    tokens: DataFrame    # token_id, cy
    total: int
    vocab: int
    l2: float = 0.5
    l1: float = 0.3
    l0: float = 0.2
    a: float = 0.1

    def base_rate(self, cy: Column) -> Column:
        return (F.coalesce(cy, F.lit(0)) + F.lit(self.a)) / F.lit(self.total + self.a * self.vocab)

    def base_weight(self, c2: Column, c1: Column) -> Column:
        return (F.lit(self.l0) + F.when(c2.isNull(), self.l2).otherwise(0.0)
                + F.when(c1.isNull(), self.l1).otherwise(0.0))

    def probability(self) -> Column:
        """p from the columns ``c2y, c2, c1y, c1, cy``."""
        def term(weight: float, part: str, whole: str) -> Column:
            return F.coalesce(F.lit(weight) * F.coalesce(F.col(part), F.lit(0)) / F.col(whole), F.lit(0.0))
        return (term(self.l2, "c2y", "c2") + term(self.l1, "c1y", "c1")
                + self.base_weight(F.col("c2"), F.col("c1")) * self.base_rate(F.col("cy")))


def fit_next_event(windows: DataFrame, vocab: int, **weights: float) -> NextEventModel:
    """Count (t2, t1, y) on training windows. All smaller contexts are sums of it.

    Every count table is stored, so that no use and no micro-batch counts again.
    """
    triples = durable(windows.groupBy(*CONTEXT, "token_id").agg(F.count(F.lit(1)).alias("c")))
    pairs = durable(triples.groupBy("t1", "token_id").agg(F.sum("c").alias("c1y")))
    contexts = durable(triples.groupBy(*CONTEXT).agg(F.sum("c").alias("c2")))
    firsts = durable(pairs.groupBy("t1").agg(F.sum("c1y").alias("c1")))
    tokens = durable(pairs.groupBy("token_id").agg(F.sum("c1y").alias("cy")))
    total = tokens.agg(F.sum("cy")).first()[0] or 0
    return NextEventModel(triples, contexts, pairs, firsts, tokens, total, vocab, **weights)


def _with_context_counts(contexts: DataFrame, m: NextEventModel) -> DataFrame:
    """Add ``c2`` and ``c1``, null for contexts that training never saw."""
    return contexts.join(m.contexts, CONTEXT, "left").join(m.firsts, "t1", "left")


def _score_triples(triples: DataFrame, m: NextEventModel) -> DataFrame:
    own = m.triples.withColumnRenamed("c", "c2y")
    counted = (_with_context_counts(triples, m).join(own, [*CONTEXT, "token_id"], "left")
               .join(m.pairs, ["t1", "token_id"], "left").join(m.tokens, "token_id", "left"))
    return counted.withColumn("p", m.probability())


def nll_of(p: Column) -> Column:
    return -F.ln(F.least(F.greatest(p, F.lit(P_FLOOR)), F.lit(1.0)))


def with_nll(windows: DataFrame, m: NextEventModel) -> DataFrame:
    """Add ``nll`` to every full-context window.

    The probability depends on the triple alone, so it is computed once per distinct
    triple; the events take part in one map-side combined count and one join. Triples with more
    rows than a task may hold are looked up in a table of bounded size, without a shuffle of their rows.
    """
    triple, limit = [*CONTEXT, "token_id"], max_group_rows(windows.sparkSession)
    counts = durable(windows.groupBy(*triple).agg(F.count(F.lit(1)).alias("_n")))
    scored = _score_triples(counts, m).select(*triple, "_n", nll_of(F.col("p")).alias("nll"))
    hot_rows = counts.agg(F.sum(F.when(F.col("_n") > limit, F.col("_n")))).first()[0]
    if hot_rows is None:
        return windows.join(scored.drop("_n"), triple)
    scored = durable(scored)
    hot = few(scored.filter(F.col("_n") > limit).drop("_n"), hot_rows // limit)
    rare = windows.join(hot.select(*triple), triple, "left_anti").join(scored.filter(F.col("_n") <= limit).drop("_n"), triple)
    return windows.join(hot, triple).unionByName(rare)


def with_nll_by_lookup(windows: DataFrame, m: NextEventModel) -> DataFrame:
    """The same by joining the count tables directly; streams cannot take a distinct first."""
    return (_score_triples(windows, m).withColumn("nll", nll_of(F.col("p")))
            .drop("p", "c2y", "c2", "c1y", "c1", "cy"))


def _followers(m: NextEventModel) -> DataFrame:
    """Tokens seen after each t1, ``t1, token_id, u``, with their probability less the share
    of t2: ``seen`` where training knows the whole context, ``new`` where it knows t1 alone."""
    near = F.lit(m.l1) * F.col("c1y") / F.col("c1")
    return m.pairs.join(m.firsts, "t1").join(m.tokens, "token_id").select(
        "t1", "token_id", m.base_rate(F.col("cy")).alias("u"),
        (near + F.lit(m.l0) * m.base_rate(F.col("cy"))).alias("seen"),
        (near + F.lit(m.l0 + m.l2) * m.base_rate(F.col("cy"))).alias("new"))


def top_predictions(contexts: DataFrame, m: NextEventModel, k: int = 5) -> DataFrame:
    """The k likeliest next tokens per distinct context: ``t2, t1, rank, token_id, p``.

    Candidates are the tokens seen after (t2, t1), the k best of those seen after t1 and the k
    most common ones. Any other token lacks the share of t2, so k candidates come before it: the
    k best followers if it was seen after t1, else the k most common tokens. Equal probabilities
    are ranked by the id. The work grows with contexts * k and the triples.
    """
    known = _with_context_counts(contexts.select(*CONTEXT).distinct(), m)
    # At most k ids.
    ids = [r["token_id"] for r in m.tokens.orderBy(F.desc("cy"), F.asc("token_id")).limit(k).collect()]
    followers, none = _followers(m), F.array().cast("array<int>")

    def best(value: str) -> DataFrame:
        w = Window.partitionBy("t1").orderBy(F.desc(value), F.asc("token_id"))
        ranked = followers.select("t1", "token_id", value).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        return ranked.groupBy("t1").agg(F.collect_list(F.col("token_id").cast("int")).alias(f"best_{value}"))

    after = F.when(F.col("c2").isNull(), F.col("best_new")).otherwise(F.col("best_seen"))
    shared = F.array_union(F.coalesce(after, none), F.array(*[F.lit(i) for i in ids]).cast("array<int>"))
    general = (known.join(best("seen"), "t1", "left").join(best("new"), "t1", "left")
               .select(*CONTEXT, F.explode(shared).alias("token_id")))
    own = m.triples.join(known.select(*CONTEXT), CONTEXT, "left_semi").select(*CONTEXT, F.col("token_id").cast("int").alias("token_id"))
    rank = F.row_number().over(Window.partitionBy(*CONTEXT).orderBy(F.desc("p"), F.asc("token_id")))
    return (_score_triples(general.unionByName(own).distinct(), m).select(*CONTEXT, "token_id", "p").withColumn("rank", rank)
            .filter(F.col("rank") <= k))


def prediction_entropy(contexts: DataFrame, m: NextEventModel) -> DataFrame:
    """Entropy of the whole next-token distribution per distinct context.

    The sum over all tokens by base rate alone is one number per base weight. The tokens seen
    after t1 correct it once per t1, those seen after (t2, t1) once per context, so the work
    grows with the pairs and triples of the model.
    """
    def part(p: Column) -> Column:
        return -(p * F.ln(p + F.lit(1e-10)))

    known = _with_context_counts(contexts.select(*CONTEXT).distinct(), m)
    levels = [(x, y, m.l0 + (m.l2 if x else 0.0) + (m.l1 if y else 0.0)) for x in (True, False) for y in (True, False)]
    rates = m.tokens.select(m.base_rate(F.col("cy")).alias("u")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(part(F.lit(w) * F.col("u"))).alias(f"s{i}") for i, (_, _, w) in enumerate(levels)]).first()
    u0 = m.a / (m.total + m.a * m.vocab)
    whole: Column = F.lit(None).cast("double")
    for i, (no_h2, no_h1, w) in enumerate(levels):
        total = F.lit(rates[f"s{i}"] or 0.0) + (m.vocab - rates["n"]) * part(F.lit(w * u0))
        whole = F.when((F.col("c2").isNull() == no_h2) & (F.col("c1").isNull() == no_h1), total).otherwise(whole)
    followers = _followers(m)
    by_first = followers.groupBy("t1").agg(
        F.sum(part(F.col("seen")) - part(F.lit(m.l0) * F.col("u"))).alias("d_seen"),
        F.sum(part(F.col("new")) - part(F.lit(m.l0 + m.l2) * F.col("u"))).alias("d_new"))
    full = F.lit(m.l2) * F.col("c") / F.col("c2") + F.col("seen")
    by_context = (m.triples.join(known.filter("c2 IS NOT NULL").select(*CONTEXT, "c2"), CONTEXT)
                  .join(followers, ["t1", "token_id"])
                  .groupBy(*CONTEXT).agg(F.sum(part(full) - part(F.col("seen"))).alias("d_own")))
    first = F.when(F.col("c2").isNull(), F.col("d_new")).otherwise(F.col("d_seen"))
    return known.join(by_first, "t1", "left").join(by_context, CONTEXT, "left").select(
        *CONTEXT, (whole + F.coalesce(first, F.lit(0.0)) + F.coalesce("d_own", F.lit(0.0))).alias("entropy"))


def evaluate_next_event(windows: DataFrame, m: NextEventModel, k: int = 5) -> DataFrame:
    """Accuracy, top-k accuracy, last-token baseline, mean and p95 NLL, perplexity, count."""
    ranked = top_predictions(windows, m, k).select(*CONTEXT, "token_id", "rank")
    scored = durable(with_nll(windows.select(*CONTEXT, "token_id"), m)
                     .join(ranked, [*CONTEXT, "token_id"], "left"))
    p95 = exact_quantile(scored, ["nll"], 0.95).first()
    return scored.agg(
        F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")).alias("accuracy"),
        F.avg(F.col("rank").isNotNull().cast("double")).alias("top_k_accuracy"),
        F.avg((F.col("t1") == F.col("token_id")).cast("double")).alias("last_token_accuracy"),
        F.avg("nll").alias("mean_nll"), F.exp(F.avg("nll")).alias("perplexity"),
        F.lit(p95["quantile"] if p95 else None).cast("double").alias("p95_nll"),
        F.count(F.lit(1)).alias("n_sequences"))


@dataclass(frozen=True)
class EntityNll:
    """Per-entity NLL mean and deviation plus the global fallback."""

    entities: DataFrame  # entity_id, mean_nll, std_nll
    mean: float
    std: float


def fit_entity_nll(windows: DataFrame, min_n: int = 5) -> EntityNll:
    """Entities with few windows or hardly any spread take the global values."""
    mean, std = windows.agg(F.avg("nll"), F.stddev_pop("nll")).first()
    std = std if std and std > 0 else 1e-6
    mean = 0.0 if mean is None else mean
    own = windows.groupBy("entity_id").agg(F.avg("nll").alias("m"), F.stddev_samp("nll").alias("s"),
                                           F.count("nll").alias("n"))
    weak = F.col("s").isNull() | F.isnan("s") | (F.col("s") <= 1e-3) | (F.col("n") < min_n)
    return EntityNll(own.select("entity_id", F.when(weak, F.lit(mean)).otherwise(F.col("m")).alias("mean_nll"),
                                F.when(weak, F.lit(std)).otherwise(F.col("s")).alias("std_nll")), mean, std)


def with_nll_z(windows: DataFrame, stats: EntityNll, name: str = "nll_z") -> DataFrame:
    joined = windows.join(stats.entities, "entity_id", "left")
    z = ((F.col("nll") - F.coalesce("mean_nll", F.lit(stats.mean)))
         / F.greatest(F.coalesce("std_nll", F.lit(stats.std)), F.lit(1e-6)))
    return joined.withColumn(name, z).drop("mean_nll", "std_nll")


def with_self_fitted_nll_z(windows: DataFrame, name: str = "nll_z") -> DataFrame:
    """NLL z against the same rows' own entity statistics."""
    own = windows.groupBy("entity_id").agg(F.avg("nll").alias("m"), F.stddev_samp("nll").alias("s"))
    std = F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, F.lit(1e-6)).otherwise(F.col("s"))
    return windows.join(own, "entity_id", "left").withColumn(name, (F.col("nll") - F.col("m")) / std).drop("m", "s")
