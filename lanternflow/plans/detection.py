"""Fit a detector on benign training events and score event streams with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import scores as S
from lanternflow.functions import values as V
from lanternflow.operators import alerts as A
from lanternflow.operators import baselines as B
from lanternflow.operators import nextevent as N
from lanternflow.operators import tokens as K
from lanternflow.operators.scale import HotKeys, hot_keys
from lanternflow.operators.windows import window_features
from lanternflow.schema import SCORE_FEATURES, WINDOW_FEATURES
from lanternflow.session import durable

WINDOW_COLUMNS = ["entity_id", "timestamp", "event_row_id", "event_type", "dst_id", "label", "token_str",
                  "token_id", "t1", "t2"]


@dataclass(frozen=True)
class Detector:
    """Everything needed to score: tokens, next-event counts, entity profiles, policy."""

    tokenizer: K.Tokenizer
    model: N.NextEventModel
    profiles: DataFrame            # entity_id, mean_nll, std_nll, med_<f>, scale_<f>
    nll_mean: float
    nll_std: float
    medians: dict[str, float]
    scales: dict[str, float]
    seq_len: int
    features: list[str] = field(default_factory=lambda: list(SCORE_FEATURES))
    variant: str = "combo_score"
    threshold: float | None = None
    allowlist: list[str] = field(default_factory=list)
    allowlist_margin: float = 0.0
    cooldown_seconds: int = 0
    version: str = "1"

    @property
    def known_entities(self) -> DataFrame:
        """Entities with their own baseline."""
        return self.profiles.filter(F.col(f"med_{self.features[0]}").isNotNull()).select("entity_id")


def windows_of(events: DataFrame, tokenizer: K.Tokenizer, seq_len: int, step: int = 1,
               keys: Sequence[str] = ("entity_id",), hot: HotKeys | None = None, enrich=None) -> DataFrame:
    """Tokenise and build full windows, stored once because several steps read them.

    ``keys`` with the split column restarts windows at split boundaries; ``entity_id``
    alone lets the context cross them. ``enrich`` runs while the rows are still grouped
    by entity, before they are stored.
    """
    hot = hot or hot_keys(events, list(keys))
    found = window_features(K.tokenize(events, tokenizer), seq_len, step, keys, hot)
    extra = [c for c in dict.fromkeys([*keys, "split"]) if c in events.columns and c not in WINDOW_COLUMNS]
    rows = found.select(*WINDOW_COLUMNS, *extra, *WINDOW_FEATURES)
    return durable(enrich(rows) if enrich else rows)


def fit_detector(train: DataFrame, seq_len: int, top_n: int, buckets: int, step: int = 1, min_windows: int = 30,
                 hot: HotKeys | None = None, tokenizer: K.Tokenizer | None = None, windows: DataFrame | None = None,
                 **policy) -> Detector:
    """Fit tokens, the next-event counts and the entity profiles on (benign) training events.

    ``windows`` saves building them if the caller has stored those of ``train`` under ``tokenizer``.
    """
    if seq_len < 2:
        raise ValueError("the next-event model needs two context tokens")
    hot = hot or hot_keys(train, ["entity_id"])
    if not hot.total:
        raise ValueError("no training events")
    tokenizer = tokenizer or K.fit_tokenizer(train, top_n, buckets, rows=hot.total)
    windows = windows_of(train, tokenizer, seq_len, step, hot=hot) if windows is None else windows
    model = N.fit_next_event(windows, tokenizer.size)
    scored = durable(N.with_nll(windows, model).select("entity_id", *SCORE_FEATURES))
    stats = N.fit_entity_nll(scored)
    base = B.fit_baselines(scored, SCORE_FEATURES, min_windows, hot)
    profiles = durable(stats.entities.join(base.entities, "entity_id", "left"))
    return Detector(tokenizer, model, profiles, stats.mean, stats.std, base.medians, base.scales, seq_len, **policy)


def with_profiles(windows: DataFrame, d: Detector, clip: float = S.Z_CLIP) -> DataFrame:
    """Join the entity profiles and turn the window features into z columns.

    What the NLL still needs is carried in ``_mean, _std, _med, _scale``. The profile
    table grows with the entities, so adaptive execution picks and splits the join.
    """
    joined = windows.join(d.profiles, "entity_id", "left")

    def own(prefix: str, f: str, shared: dict[str, float]) -> Column:
        return F.coalesce(f"{prefix}_{f}", F.lit(shared[f]))

    return joined.select(
        *[F.col(c) for c in windows.columns], F.col(f"med_{d.features[0]}").isNotNull().alias("has_baseline"),
        *[S.robust_z(F.col(f), own("med", f, d.medians), own("scale", f, d.scales), clip).alias(f"z_{f}")
          for f in d.features if f != "nll"],
        F.coalesce("mean_nll", F.lit(d.nll_mean)).alias("_mean"),
        F.greatest(F.coalesce("std_nll", F.lit(d.nll_std)), F.lit(1e-6)).alias("_std"),
        own("med", "nll", d.medians).alias("_med"), own("scale", "nll", d.scales).alias("_scale"))


def score_profiled(rows: DataFrame, d: Detector, ablations: dict[str, Sequence[str]] | None = None,
                   clip: float = S.Z_CLIP, add_nll=N.with_nll) -> DataFrame:
    """Add nll, nll_z, ``z_nll``, ``score``, ablated scores and the top feature."""
    kept = {n: S.kept_features(d.features, dropped) for n, dropped in (ablations or {}).items()}
    z = add_nll(rows, d.model).withColumns({
        "nll_z": (F.col("nll") - F.col("_mean")) / F.col("_std"),
        "z_nll": S.robust_z(F.col("nll"), F.col("_med"), F.col("_scale"), clip)}).drop("_mean", "_std", "_med", "_scale")
    combo = S.mean_abs([F.col(f"z_{f}") for f in d.features])
    by_nll = d.variant in ("nll_z", "entity_nll_z")
    return z.select("*", (F.col("nll_z") if by_nll else combo).alias("score"),
                    (F.lit("nll") if by_nll else S.top_feature(d.features)).alias("top_contributing_feature"),
                    *[S.mean_abs([F.col(f"z_{f}") for f in names]).alias(f"score_{n}") for n, names in kept.items()])


def _in_cooldown(scored: DataFrame, emitted: DataFrame, seconds: int) -> DataFrame:
    """Mark rows that follow an emitted alert of their entity by less than the cooldown.

    Emitted alerts are at least one cooldown apart, so a row meets at most one of them;
    time slots of that length turn the range condition into an equality join.
    """
    step = seconds * 1_000_000
    at = F.unix_micros("timestamp")
    slot = F.floor(at / F.lit(step))
    marks = emitted.select(F.col("entity_id").alias("_e"), at.alias("_t0"), F.col("event_row_id").alias("_r0"),
                           F.explode(F.array(slot, slot + 1)).alias("_slot"))
    after = (at > F.col("_t0")) | ((at == F.col("_t0")) & (F.col("event_row_id") > F.col("_r0")))
    near = (F.col("entity_id") == F.col("_e")) & (slot == F.col("_slot")) & after & (at - F.col("_t0") < step)
    return (scored.join(marks, near, "left").withColumn("_dup", F.col("_t0").isNotNull())
            .drop("_e", "_t0", "_r0", "_slot"))


def apply_policy(scored: DataFrame, d: Detector) -> DataFrame:
    """Add threshold, is_anomaly and suppressed (allowlist or cooldown)."""
    t = F.lit(float(d.threshold))
    listed = ~A.passes_allowlist("score", t, d.allowlist, d.allowlist_margin)
    if d.cooldown_seconds > 0:
        scored = durable(scored)
        hits = scored.filter((F.col("score") >= t) & ~listed)
        kept = hits.join(A.cooldown(hits, d.cooldown_seconds), "event_row_id", "left_semi")
        marked = _in_cooldown(scored, durable(kept.select("entity_id", "timestamp", "event_row_id")),
                              d.cooldown_seconds)
    else:
        marked = scored.withColumn("_dup", F.lit(False))
    off = listed | F.col("_dup")
    return marked.select(*[F.col(c) for c in scored.columns], t.alias("threshold"),
                         ((F.col("score") >= t) & ~off).alias("is_anomaly"), off.alias("suppressed"),
                         F.lit(d.version).alias("model_version"))


def score_events(events: DataFrame, d: Detector, ablations: dict[str, Sequence[str]] | None = None,
                 keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Batch twin of the streaming scorer: one time-ordered stream, context crosses splits."""
    rows = windows_of(events, d.tokenizer, d.seq_len, keys=keys, enrich=lambda w: with_profiles(w, d))
    return score_profiled(rows, d, ablations)


def benign_of(scored: DataFrame) -> DataFrame:
    return scored.filter(V.is_benign(F.col("label")))


def describe_scores(scored: DataFrame, d: Detector, k: int = 5) -> DataFrame:
    """Readable report columns: reason, names of the true and the k predicted events, destination."""
    names = K.vocabulary(d.tokenizer)
    top = N.top_predictions(scored, d.model, k).join(names, "token_id", "left")
    cell = F.struct("rank", K.token_name(F.col("token_id"), F.col("token_str")).alias("name"), "p")
    listed = top.groupBy(*N.CONTEXT).agg(F.array_sort(F.collect_list(cell)).alias("_top")).select(
        *N.CONTEXT, F.concat_ws(", ", F.transform("_top", lambda c: c["name"])).alias("predicted_events"),
        F.concat_ws(", ", F.transform("_top", lambda c: F.format_string("%.3f", c["p"]))).alias("predicted_probs"))
    true_name = K.token_name(F.col("token_id"), F.col("_name"))
    named = scored.join(names.select("token_id", F.col("token_str").alias("_name")), "token_id", "left")
    return (named.join(listed, N.CONTEXT, "left")
            .withColumn("true_next_event", true_name).drop("_name")
            .withColumn("dst_parsed", K.destination_of(F.col("true_next_event")))
            .withColumn("reason", V.reason_band(F.col("nll_z")))
            .withColumn("combo_reason", F.concat(F.col("top_contributing_feature"),
                                                 F.lit(" deviates from entity baseline"))))


def top_alerts(events: DataFrame, seq_len: int = 3, top_n: int = 5, buckets: int = 4, target_fpr: float = 0.01,
               top_k: int | None = None, max_per_entity: int | None = None) -> DataFrame:
    """Train on benign training rows, calibrate on benign development rows, list test alerts."""
    from dataclasses import replace

    from lanternflow.operators.thresholds import operating_thresholds

    train = events.filter((F.col("split") == "train") & V.is_benign(F.col("label")))
    d = fit_detector(train, seq_len, top_n, buckets)
    scored = durable(score_events(events.filter(F.col("split") != "train"), d, keys=("split", "entity_id")))
    t = operating_thresholds(benign_of(scored.filter(F.col("split") == "dev")), ["score"], target_fpr,
                             {"score": 2.0})["score"]
    d = replace(d, threshold=t)
    return A.select_alerts(apply_policy(scored.filter(F.col("split") == "test"), d).filter("is_anomaly"),
                           "score", t, top_k, max_per_entity)
