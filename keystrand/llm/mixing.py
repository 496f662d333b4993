"""Soft-membership mixing, in DataFrame functions only.

Domains are what labels tell apart: toxic (toxic = 1), else low (quality = 0),
else clean.  A naive Bayes classifier is fitted on a bounded sample of labelled
documents.  Features are the words and a few marks of form (many symbols,
capitals, repeated words); those frequent enough in a class and far more
frequent than outside of it are typical of it.  A document's log-odds of a class
against all others are the class's prior and a sum over its typical features: of
log p / q for one that the document has, of log (1 - p) / (1 - q) for one that it has
not, p and q being the shares of documents with it inside and outside of the class.
Features go together, so the absence of all of them says more than that sum: documents
without any have the odds that the labelled ones without any have.
As features were chosen for being rare outside, q is taken to be somewhat more than
was seen (`STRAY`).  The odds of low and toxic, with 1 for clean, give every document
posteriors over the domains.

Document rates r >= 0 are fitted by projected gradient descent to

    sum over domains k of m_k e_k ^ 2, e_k = (sum_d r_d t_d p_dk - b_k) / m_k,
        + ridge * (departure of the rates from 1, by tokens),

t being tokens, p posteriors, b the targets and m a domain's present tokens.  A step
takes sum_k p_dk e_k + ridge * (r_d - 1) off each rate; as the posteriors of a document
add up to 1, a step of 1 / (1 + ridge) never overshoots.  Steps end when every domain is
within `CLOSE` of its target (of the whole, for a target of 0), when a step changes no e_k
by `STILL`, or after `STEPS`.
Documents with equal posteriors have equal rates throughout, so the tokens are
first summed up by posterior vector; each step is one aggregate of that table,
of which the driver sees one number for each domain.

Targets are shares of the mixture; its size is such that the clean domain's
present tokens meet the clean share (all tokens, if that share is 0).

The sample is the `MAX_LABELLED` labelled ids of least hash, and the model has
at most `MAX_FEATURES` features for each class: both bounds are parameters of the
classifier; all documents are scored, weighed and drawn.

Edge cases: null texts have no words and get the prior; documents without a
label are scored like others; several labels of one id count as toxic or low if
any says so, null labels are left out; labels without a document are ignored;
a class without labelled documents has no members, so without labels every document
is clean; repeated rows each get their rate; features
of equal rank are taken in the order of their bytes; a text of any length is taken
whole; other columns, whatever their names, are passed through; an empty table gives
an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.98, "low": 0.02, "toxic": 0.0}
MAX_LABELLED, MAX_FEATURES = 20_000, 256
LEAST_SHARE, LEAST_DOCS, LIFT = 0.015, 3, 30.0
STRAY = 0.02  # documents of other classes that have one of a class's features, at least
RIDGE, STEPS, CLOSE, STILL = 1e-4, 60, 0.002, 1e-4
CLEAN = 0.9  # posterior from which draw() takes a document once
MOST_BROADCAST = 4_000_000  # rows of 16 bytes
CAPITALS, SYMBOLS = "[A-Z]", "[#*$%&|<>]"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # words are runs of letters and of whatever is not ASCII


def _features(docs: DataFrame, *keep: str) -> DataFrame:
    """docs(text) with n_tokens and `words`: distinct words in small letters, and marks."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*keep, F.split(F.lower(text), BETWEEN).alias("all"), F.regexp_count(text, F.lit(SYMBOLS)).alias("sym"), F.regexp_count(text, F.lit(CAPITALS)).alias("cap"), F.length(text).alias("len"))
    # Splitting leaves an empty piece at an end that is no word.
    empty = F.when(F.get("all", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("all") > 1) & (F.element_at("all", -1) == ""), 1).otherwise(0)
    out = out.select(*keep, (F.size("all") - empty).cast("long").alias("n_tokens"), F.array_remove(F.array_distinct("all"), "").alias("words"), "sym", "cap", "len")
    n = F.col("n_tokens")
    marks = F.array(
        F.when(F.col("sym") * 5 > n, F.lit("#symbols")), F.when(F.col("cap") * 4 > F.col("len"), F.lit("#capitals")), F.when((n >= 20) & (F.size("words") * 4 < n), F.lit("#repeats"))
    )
    return out.select(*keep, "n_tokens", F.concat("words", F.array_compact(marks)).alias("words"))


class Classifier:
    """For each class but the first: log-odds without any typical feature, those from which the others start, and what each feature that a document has adds."""

    def __init__(self, none: list[float], base: list[float], weights: list[dict[str, float]]):
        self.none, self.base, self.weights = none, base, weights

    def features(self) -> list[str]:
        return sorted({x for w in self.weights for x in w})

    def odds(self, hits: Column) -> list[Column]:
        """Odds against the first class, from the column of a document's typical features."""

        def total(none: float, base: float, weights: dict[str, float]) -> Column:
            if not weights:
                return F.lit(none)
            table = F.create_map(*(F.lit(x) for f, w in sorted(weights.items()) for x in (f, w)))
            found = F.array_compact(F.transform(hits, lambda f: F.try_element_at(table, f)))
            return F.when(F.size(found) == 0, F.lit(none)).otherwise(F.aggregate(found, F.lit(base), lambda a, w: a + w))

        return [F.exp(F.least(total(*x), F.lit(50.0))) for x in zip(self.none, self.base, self.weights, strict=True)]


def _having(words: Column, names: list[str]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, names)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Classifier:
    """docs: (id, text); labels: (id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("id is not null and quality is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).select("id", domain.alias("k"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # bounded, so it can be broadcast
    rows = _scratch.write(_features(docs.join(F.broadcast(sample), "id"), "k"), "labelled", files=8)
    have = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    size = [have.get(k, 0) for k in range(len(DOMAINS))]
    total = sum(size)
    counts = rows.select("k", F.explode("words").alias("f")).groupBy("f").agg(*(F.sum(F.when(F.col("k") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(len(DOMAINS))))
    counts = _scratch.write(counts.where(f"n0 + n1 + n2 >= {LEAST_DOCS}"), "features", files=8)
    none, base, every = [], [], []
    for k in range(1, len(DOMAINS)):
        mine, rest = F.col(f"n{k}"), F.col("n0") + F.col("n1") + F.col("n2") - F.col(f"n{k}")
        lift = (mine + 0.5) / (size[k] + 1) / ((rest + 0.5) / (total - size[k] + 1))
        best = counts.where((mine >= max(LEAST_DOCS, LEAST_SHARE * size[k])) & (lift >= LIFT)).orderBy(F.desc(mine * F.log(lift)), "f").limit(max_features)
        found = best.select("f", mine.alias("mine"), rest.alias("rest")).collect()
        odds = prior = math.log((size[k] + 0.5) / (size[0] + 0.5)) if size[k] else -30.0  # no labelled document, no members
        weights = {}
        for f, n, other in found:
            p = (n + 0.5) / (size[k] + 1)
            q = (other + 0.5) / (total - size[k] + 1) + STRAY / len(found)
            odds += math.log((1 - p) / (1 - q))
            weights[f] = math.log(p / (1 - p)) - math.log(q / (1 - q))
        without = {r["k"]: r["count"] for r in rows.where(F.size(_having(F.col("words"), list(weights))) == 0).groupBy("k").count().collect()} if weights else have
        p, q = (without.get(k, 0) + 0.5) / (size[k] + 1), (sum(without.values()) - without.get(k, 0) + 0.5) / (total - size[k] + 1)
        none.append(prior + math.log(p / q))
        base.append(odds)
        every.append(weights)
    _scratch.drop(rows)
    _scratch.drop(counts)
    return Classifier(none, base, every)


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, kept columns, n_tokens and p_clean, p_low, p_toxic of every row of docs."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(named, labels.select(F.col(id_col).alias("id"), "quality", "toxic"))
    all_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    kept = ["id", *(f"_{i}" for i in range(len(keep)))]
    names = model.features()
    out = _features(all_, *kept).select(*kept, "n_tokens", (_having(F.col("words"), names) if names else F.array().cast("array<string>")).alias("hits"))
    # Most documents have no typical feature; the odds are worked out for the others.
    odds = F.when(F.size("hits") == 0, F.array(*(F.lit(math.exp(x)) for x in model.none))).otherwise(F.array(*model.odds(F.col("hits"))))
    out = out.select(*kept, "n_tokens", odds.alias("odds"))
    whole = F.lit(1.0) + sum((F.get("odds", F.lit(k)) for k in range(1, len(model.base))), F.get("odds", F.lit(0)))
    p = [F.round(F.get("odds", F.lit(k)) / whole, 4) for k in range(len(model.base))]
    p = [F.round(F.lit(1.0) - sum(p[1:], p[0]), 4), *p]
    return out.select(F.col("id").alias(id_col), *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", *(x.alias(f"p_{d}") for x, d in zip(p, DOMAINS, strict=True)))


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps so far, as a function of a row's posteriors."""
    if not history:
        return F.lit(1.0)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    steps = F.array(*(F.array(*map(F.lit, e)) for e in history))

    def step(r: Column, e: Column) -> Column:
        slope = sum((p[k] * F.get(e, F.lit(k)) for k in range(1, len(p))), p[0] * F.get(e, F.lit(0)))
        return F.greatest(F.lit(0.0), r - (slope + F.lit(RIDGE) * (r - 1)) / F.lit(1 + RIDGE))

    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(scored: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS) -> list[list[float]]:
    """The gradient of every step; scored has n_tokens and the posteriors."""
    groups = _scratch.write(scored.groupBy(*(f"p_{d}" for d in DOMAINS)).agg(F.sum("n_tokens").alias("n_tokens")), "posteriors", files=1)
    totals = lambda h: [float(x or 0) for x in groups.select("n_tokens", *(f"p_{d}" for d in DOMAINS), _rate(h).alias("r")).agg(*(F.sum(F.col("n_tokens") * F.col("r") * F.col(f"p_{d}")) for d in DOMAINS)).first()]
    present = totals([])
    share = [targets.get(d, 0.0) / (sum(targets.values()) or 1.0) for d in DOMAINS]
    size = present[0] / share[0] if share[0] > 0 else sum(present)
    goal = [size * s for s in share]
    history: list[list[float]] = []
    for _ in range(steps):
        now = totals(history) if history else present
        if all(abs(a - b) <= CLOSE * (b or size) for a, b, m in zip(now, goal, present, strict=True) if m > 0):
            break
        slope = [(a - b) / m if m > 0 else 0.0 for a, b, m in zip(now, goal, present, strict=True)]
        if history and max(abs(x - y) for x, y in zip(slope, history[-1], strict=True)) < STILL:
            break
        history.append(slope)
    _scratch.drop(groups)
    return history


def rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row for each row of docs: id, n_tokens, posteriors and rate."""
    scored = _scratch.write(posteriors(docs, labels, id_col, text_col), "scored")
    return scored.withColumn("rate", _rate(fit_rates(scored, targets)))


def draw(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says.

    A rate's whole part is a number of copies; a hash of id and text decides about one more, with the
    odds of the rest, so that the expected tokens are those of the rates.  Clean documents, whose rates
    are near 1, are taken once (unless the clean target is 0).
    """
    since = _scratch.mark()
    key = F.xxhash64(id_col, text_col)
    scored = _scratch.write(posteriors(docs.select(id_col, text_col, key.alias("_key")), labels, id_col, text_col, "_key"), "scored")
    rate = _rate(fit_rates(scored, targets))
    if targets.get("clean", 0.0) > 0:
        rate = F.when(F.col("p_clean") >= CLEAN, F.lit(1.0)).otherwise(rate)
    copies = F.floor(rate + F.pmod(F.xxhash64(F.lit("copies"), "_key"), F.lit(1 << 32)) / (1 << 32)).cast("int").alias("_copies")
    other = _scratch.write(scored.select("_key", copies).where("_copies <> 1").distinct(), "copies")
    _scratch.release(since, other)
    other = F.broadcast(other) if other.count() <= MOST_BROADCAST else other.hint("merge")
    out = docs.alias("d").join(other.alias("o"), F.xxhash64(F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`")) == F.col("o._key"), "left")
    every = F.struct(*(F.col(f"d.`{c}`") for c in docs.columns))
    return out.select(F.explode(F.array_repeat(every, F.coalesce("o._copies", F.lit(1)))).alias("d")).select("d.*")


def shares(rated: DataFrame) -> list[float]:
    """Expected shares of the domains in the mixture; rated: what rates() returns."""
    sums = [float(x or 0) for x in rated.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")) for d in DOMAINS)).first()]
    return [x / (sum(sums) or 1.0) for x in sums]
