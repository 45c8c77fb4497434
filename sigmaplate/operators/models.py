"""Ready-made models as dataflow: discrete networks, evidence, topics, crowd confusion, skills, clicks, motifs, words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import digamma, gamma_ln, log_sum_exp_over, normal_cdf
from ..functions.special import log_sum_exp, softmax


def states(spark: SparkSession, variables: list[str]) -> DataFrame:
    """All joint states of a few binary variables, 2 ** n rows: columns of 0 and 1."""
    n = len(variables)
    bits = [F.shiftright("id", k).bitwiseAND(1).cast("int").alias(v) for k, v in enumerate(variables)]
    return spark.range(1 << n).select(*bits)


def marginal(joint: DataFrame, weight: Column, query: str, evidence: Column | None = None) -> DataFrame:
    """(query, probability) from weighted joint states that satisfy the evidence."""
    kept = joint if evidence is None else joint.where(evidence)
    sums = kept.groupBy(query).agg(F.sum(weight).alias("w"))
    return sums.join(F.broadcast(sums.agg(F.sum("w").alias("z")))).select(query, (F.col("w") / F.col("z")).alias("probability"))  # one row


def table_lookup(rows: DataFrame, table: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with the entry of a conditional probability table (on..., p) as a column."""
    return rows.join(F.broadcast(table.withColumnRenamed("p", name)), on)  # a table of the network, not of the data


def two_rate_evidence(groups: DataFrame, yes: str, n: str, arm: str) -> DataFrame:
    """Does a treatment matter?  From counts (arm, yes, n) of two arms: log evidences of one common rate and of a rate each,
    under uniform priors, and the posterior probability of the second with even odds."""

    def evidence(y: Column, m: Column) -> Column:
        return gamma_ln(y + 1.0) + gamma_ln(m - y + 1.0) - gamma_ln(m + 2.0)

    y, m = F.col(yes).cast("double"), F.col(n).cast("double")
    sums = groups.agg(F.sum(evidence(y, m)).alias("each"), F.sum(y).alias("y"), F.sum(m).alias("m"))
    common = evidence(F.col("y"), F.col("m"))
    return sums.select(common.alias("common"), "each", (F.lit(1.0) / (F.exp(common - F.col("each")) + 1.0)).alias("effective"))


def gaussian_sweeps(stats: DataFrame, n: str, mean: str, variance: str, sweeps: int, m0: float, v0: float, shape0: float, rate0: float) -> DataFrame:
    """stats with the factorised posterior of mean and precision after a number of variational sweeps, from sufficient statistics alone."""
    out = stats.withColumns({"m": F.lit(m0), "v": F.lit(v0), "shape": F.lit(shape0) + F.col(n) / 2.0, "rate": F.lit(rate0)})
    for _ in range(sweeps):
        gap = F.col(mean) - F.col("m")
        out = out.withColumn("rate", F.lit(rate0) + F.col(n) * (F.col(variance) + gap * gap + F.col("v")) / 2.0)
        precision = F.col("shape") / F.col("rate")
        out = out.withColumn("v", F.lit(1.0) / (F.lit(1.0 / v0) + F.col(n) * precision))
        out = out.withColumn("m", F.col("v") * (F.lit(m0 / v0) + F.col(n) * precision * F.col(mean)))
    return out


def gaussian_evidence(stats: DataFrame, n: str, mean: str, variance: str, m0: float, v0: float, noise: float) -> DataFrame:
    """stats with log_evidence of rows around a Gaussian mean with known noise, from sufficient statistics."""
    k, x, s = F.col(n).cast("double"), F.col(mean), F.col(variance)
    inside = -(k * math.log(2 * math.pi * noise) + k * s / noise) / 2.0
    spread = F.lit(v0) + F.lit(noise) / k
    outside = -(F.log(spread) - F.log(F.lit(noise) / k) + (x - m0) * (x - m0) / spread) / 2.0
    return stats.withColumn("log_evidence", inside + outside)


# Words


def words(data: DataFrame, row: str, text: str, stop: list[str]) -> DataFrame:
    """(row, word, n): counts of lower-cased words of letters and digits that aren't stop words."""
    cut = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", ""), r"\s+"), lambda w: (w != "") & ~w.isin(stop))
    return data.select(row, F.explode(cut).alias("word")).groupBy(row, "word").agg(F.count("*").alias("n"))


def tf_idf(counts: DataFrame, row: str, documents: DataFrame, least: int = 3) -> DataFrame:
    """(row, word, weight): counts times ln(N / (1 + documents with the word)), scaled to length 1 for each row.

    counts: (row, word, n); words that occur fewer than ``least`` times in all are left out.
    """
    vocabulary = counts.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("df")).where(F.col("total") >= least)
    size = documents.agg(F.count("*").alias("N"))  # one row
    weights = vocabulary.join(F.broadcast(size)).select("word", F.log(F.col("N") / (F.col("df") + 1.0)).alias("idf"))
    each = counts.join(weights, "word").select(row, "word", (F.col("n") * F.col("idf")).alias("w"))
    norms = each.groupBy(row).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.join(norms, row).select(row, "word", F.try_divide("w", "norm").alias("weight"))


def topic_sweep(counts: DataFrame, row: str, topics: int, belief: DataFrame | None = None, alpha: float = 0.1, beta: float = 0.01) -> DataFrame:
    """(row, word, n, p): a variational sweep of a topic model; p is the array of the topics' probabilities of the word in the row.

    counts: (row, word, n); belief: the last sweep's result, hashed shares at first.  Pseudo-counts
    of rows by topic and of words by topic are grouped sums of belief times count.
    """
    if belief is None:
        place = lambda k: F.pmod(F.crc32(F.concat(F.col(row).cast("string"), F.lit("|"), F.col("word"))) * (2 * k + 1) + 7 * k, F.lit(1000)) + 1
        raw = F.array(*[place(k).cast("double") for k in range(topics)])
        belief = counts.withColumn("p", F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)))
    mass = [F.sum(F.col("n") * F.col("p")[k]).alias(f"k{k}") for k in range(topics)]
    by_row = belief.groupBy(row).agg(*mass).select(row, *[(F.col(f"k{k}") + alpha).alias(f"a{k}") for k in range(topics)])
    by_word = belief.groupBy("word").agg(*mass).select("word", *[(F.col(f"k{k}") + beta).alias(f"b{k}") for k in range(topics)])
    totals = by_word.agg(*[F.sum(f"b{k}").alias(f"t{k}") for k in range(topics)])  # one row
    both = belief.select(row, "word", "n").join(by_row, row).join(by_word, "word").join(F.broadcast(totals))
    score = F.array(*[digamma(F.col(f"a{k}")) + digamma(F.col(f"b{k}")) - digamma(F.col(f"t{k}")) for k in range(topics)])
    return both.select(row, "word", "n", softmax(score).alias("p"))


# Crowd labels with confusion matrices


def confusion_sweep(votes: DataFrame, belief: DataFrame, labels: list[int], pseudo: float = 1.0) -> DataFrame:
    """New belief (task, label, p) from votes (task, worker, vote) and a belief: workers' confusion matrices, then products of messages."""
    k = len(labels)
    cells = votes.join(belief, "task").groupBy("worker", "label", "vote").agg(F.sum("p").alias("m"))
    totals = cells.groupBy("worker", "label").agg(F.sum("m").alias("t"))
    prior = belief.groupBy("label").agg(F.sum("p").alias("s"))
    prior = prior.join(F.broadcast(prior.agg(F.sum("s").alias("z")))).select("label", F.log(F.col("s") / F.col("z")).alias("prior"))  # one row
    matrix = cells.join(totals, ["worker", "label"]).select("worker", "label", "vote", F.log((F.col("m") + pseudo) / (F.col("t") + k * pseudo)).alias("l"))
    scores = votes.join(matrix, ["worker", "vote"]).groupBy("task", "label").agg(F.sum("l").alias("s"))
    scores = scores.join(F.broadcast(prior), "label").select("task", "label", (F.col("s") + F.col("prior")).alias("s"))
    best = scores.groupBy("task").agg(F.max("s").alias("top"), F.collect_list(F.struct("label", "s")).alias("all"))  # one entry a label
    shares = best.withColumn("z", F.aggregate("all", F.lit(0.0), lambda t, e: t + F.exp(e["s"] - F.col("top"))))
    return shares.select("task", "z", "top", F.explode("all").alias("e")).select("task", "e.label", (F.exp(F.col("e.s") - F.col("top")) / F.col("z")).alias("p"))


def community_confusion(votes: DataFrame, belief: DataFrame, community: DataFrame, labels: list[int], pseudo: float = 1.0) -> DataFrame:
    """(community, label, vote, p): confusion matrices shared by the workers of a community (worker, community)."""
    cells = votes.join(community, "worker").join(belief, "task").groupBy("community", "label", "vote").agg(F.sum("p").alias("m"))
    totals = cells.groupBy("community", "label").agg(F.sum("m").alias("t"))
    return cells.join(totals, ["community", "label"]).select("community", "label", "vote", ((F.col("m") + pseudo) / (F.col("t") + len(labels) * pseudo)).alias("p"))


def most_uncertain(belief: DataFrame, top: int) -> DataFrame:
    """The tasks of the highest entropy, for which the next label tells most."""
    entropy = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0))
    return belief.groupBy("task").agg(entropy.alias("entropy")).orderBy(F.desc(F.round("entropy", 9)), "task").limit(top)


# Skills, clicks, ratings of players, motifs


def skill_posterior(answers: DataFrame, student: str, needs: dict[str, list[str]], guess: float, slip: float, prior: float = 0.5) -> DataFrame:
    """(student, a column of probability for each skill): all combinations of skills weighed by the answers (columns of true and false).

    An answer is right with 1 - slip if all skills that it needs are there, else with guess.
    """
    skills = sorted({s for n in needs.values() for s in n})
    each = answers.join(F.broadcast(states(answers.sparkSession, [f"has_{s}" for s in skills])))
    weight = F.lit(1.0)
    for s in skills:
        weight = weight * F.when(F.col(f"has_{s}") == 1, prior).otherwise(1 - prior)
    for question, of in needs.items():
        able = F.lit(True)
        for s in of:
            able = able & (F.col(f"has_{s}") == 1)
        right = F.when(able, 1 - slip).otherwise(guess)
        weight = weight * F.when(F.col(question), right).otherwise(F.lit(1.0) - right)
    sums = each.select(student, *[f"has_{s}" for s in skills], weight.alias("w")).groupBy(student)
    return sums.agg(*[(F.sum(F.col(f"has_{s}") * F.col("w")) / F.sum("w")).alias(s) for s in skills])


def cascade(impressions: DataFrame, session: str, rank: str, clicked: Column, item: str) -> DataFrame:
    """(item, examined, clicks, appeal): a cascade of clicks, where places down to the first click are examined."""
    first = impressions.groupBy(session).agg(F.min(F.when(clicked, F.col(rank))).alias("first"))
    seen = impressions.join(first, session).where(F.col("first").isNull() | (F.col(rank) <= F.col("first")))
    s = seen.groupBy(item).agg(F.count("*").alias("examined"), F.sum(clicked.cast("long")).alias("clicks"))
    return s.select(item, "examined", "clicks", ((F.col("clicks") + 1.0) / (F.col("examined") + 2.0)).alias("appeal"))


def faster(a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Probability that the first of two uncertain times is the shorter."""
    return normal_cdf((b - a) / F.sqrt(va + vb))


def motif_positions(data: DataFrame, row: str, text: str, motif: list[dict[str, float]], background: float) -> DataFrame:
    """(row, position, p): where a motif, probabilities of characters by place, lies in a string; every place is as likely before.

    Strings are dealt by ``row`` and scored as arrays; the places of rows that share a ``row``, null too, add up to 1.
    """
    n = len(motif)
    gain = lambda p: F.lit(math.log(p / background) if p else float("-inf"))

    def score(position: Column) -> Column:
        s = F.lit(0.0)
        for k, of in enumerate(motif):
            at = F.substring(F.col("t"), position + 1 + k, F.lit(1))
            g = gain(of.get("", 1e-3))
            for ch, w in of.items():
                if ch:
                    g = F.when(at == ch, gain(w)).otherwise(g)
            s = s + g
        return s

    each = data.where(F.length(text) >= n).select(row, F.col(text).alias("t")).repartition(row)
    each = each.select(row, F.transform(F.sequence(F.lit(0), F.length("t") - n), score).alias("scores"))
    each = each.withColumn("z", log_sum_exp_over(log_sum_exp(F.col("scores")), Window.partitionBy(row)))
    return each.select(row, F.posexplode("scores").alias("position", "s"), "z").select(row, "position", F.exp(F.col("s") - F.col("z")).alias("p"))


def skill_round(games: DataFrame, skills: DataFrame, noise: float) -> DataFrame:
    """skills (player, mean, variance) after a round of games (winner, loser): each game's messages come from the skills before
    the round, and a player's messages are added up."""
    from .factor_messages import greater_posteriors

    s = lambda who, m: skills.select(F.col("player").alias(who), F.col("mean").alias(f"{m}m"), F.col("variance").alias(f"{m}v"))
    both = games.join(s("winner", "w"), "winner").join(s("loser", "l"), "loser")
    # The performances' noise goes to the difference: half to each side of the comparison.
    g = greater_posteriors(F.col("wm"), F.col("wv") + noise, F.col("lm"), F.col("lv") + noise)
    both = both.select("*", g.alias("g"))

    def message(side: str, who: str, letter: str) -> DataFrame:
        m, v = F.col(f"g.mean_{letter}"), F.col(f"g.variance_{letter}")
        prec = F.lit(1.0) / v - F.lit(1.0) / (F.col(f"{side}v") + noise)
        tau = m / v - F.col(f"{side}m") / (F.col(f"{side}v") + noise)
        # Through the noise back to the skill.
        scale = F.lit(1.0) / (prec * noise + 1.0)
        return both.select(F.col(who).alias("player"), (tau * scale).alias("tau"), (prec * scale).alias("prec"))

    sums = message("w", "winner", "a").unionByName(message("l", "loser", "b")).groupBy("player").agg(F.sum("tau").alias("tau"), F.sum("prec").alias("prec"))
    new = skills.join(sums, "player", "left").fillna(0.0, ["tau", "prec"])
    prec = F.lit(1.0) / F.col("variance") + F.col("prec")
    return new.select("player", ((F.col("mean") / F.col("variance") + F.col("tau")) / prec).alias("mean"), (F.lit(1.0) / prec).alias("variance"))


def calibrated_scores(reviews: DataFrame, item: str, judge: str, score: str, sweeps: int = 2, noise: float = 1.0) -> DataFrame:
    """(item, quality): means of the items after the judges' offsets are taken out, by alternating shrunken means."""
    offsets = None
    for _ in range(sweeps):
        left = reviews if offsets is None else reviews.join(offsets, judge)
        own = F.col(score) if offsets is None else F.col(score) - F.col("offset")
        quality = left.groupBy(item).agg((F.sum(own) / (F.count("*") + noise)).alias("quality"))
        offsets = reviews.join(quality, item).groupBy(judge).agg((F.sum(F.col(score) - F.col("quality")) / (F.count("*") + noise)).alias("offset"))
    return reviews.join(offsets, judge).groupBy(item).agg((F.sum(F.col(score) - F.col("offset")) / (F.count("*") + noise)).alias("quality"))


def principal_directions(gram: DataFrame, n: int, iterations: int = 50) -> list[list[float]]:
    """The n leading eigenvectors of a symmetric matrix (i, j, v) of the size of the features, by orthogonal iteration."""
    import numpy as np

    cells = gram.collect()
    d = 1 + max((r["i"] for r in cells), default=-1)
    a = np.zeros((d, d))
    for r in cells:
        a[r["i"], r["j"]] = r["v"]
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(n, d))))[0]
    for _ in range(iterations):
        q = np.linalg.qr(a @ q)[0]
    return [(v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)).tolist() for v in q.T]


def rolling_top(data: DataFrame, key: list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each key, as a bounded priority queue keeps them."""
    return data.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= top)
