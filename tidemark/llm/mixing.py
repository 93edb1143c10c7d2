"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The expected number of copies of a cell's documents is raked
until the sources meet their targets and languages and topics keep their shares of the corpus, with every cell held
at its source's cap of repeats; the last step always belongs to the sources. A document then gets the whole copies
of its cell and one more with a calibrated probability: its uniform number, a hash of its id, is compared with the
fraction times a factor of its source, and that factor is set from the tokens by uniform number (at most 8,192 sums
a source) so that the tokens drawn meet the target and not only their expectation.

A source that can't reach its share even with all repeats gets all of them; the others keep their share of the size.

Only sums by cell come to the driver: sources of the targets x languages (two letters) x at most 50 topics.

Defined results: documents with a null source, or one without a target, are never selected; null, empty and blank
texts count the tokens they have; a null language or topic is a value of its own; repeated texts are documents of
their own; a source without documents is reported with no tokens; targets with a null source or share are ignored; a
null cap is 1. Without documents nothing is selected and every source with a share above zero is out of reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .tokens import VOCABULARY, count_tokens

BINS = 4096
TOPIC_SHARE = 0.02
MAX_SOURCES = 10_000


def language(c: Column) -> Column:
    """Two lower-case letters, or 'und' for anything else: 'en-GB' and ' EN' are 'en'."""
    two = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"^\s*([a-z]{2})(?:[-_].*|\s*)$", 1)
    return F.when(two == "", "und").otherwise(two)


def rake(tokens: np.ndarray, targets: np.ndarray, caps: np.ndarray, rounds: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Expected copies of each cell [source, language, topic], at most caps[source]; zero where there are no tokens."""
    copies = np.ones_like(tokens)
    cap = caps[:, None, None]
    total = targets.sum()
    whole = tokens.sum()
    if not whole:
        return np.zeros_like(tokens)

    def to_sources(copies: np.ndarray) -> np.ndarray:
        """Meet the source targets; what the cap cuts off goes to the source's other cells."""
        for _ in range(50):
            copies = np.minimum(copies, cap)
            now = (copies * tokens).sum(axis=(1, 2))
            free = np.where(copies < cap, copies * tokens, 0).sum(axis=(1, 2))
            short = targets - now
            if np.all((np.abs(short) <= tol * max(total, 1)) | ((short > 0) & (free <= 0))):
                break
            grow = np.where(short > 0, 1 + short / np.maximum(free, 1e-300), targets / np.maximum(now, 1e-300))
            copies = np.where((short[:, None, None] > 0) & (copies >= cap), copies, copies * grow[:, None, None])
        return np.minimum(copies, cap)

    for _ in range(rounds):
        before = copies
        copies = to_sources(copies)
        size = (copies * tokens).sum()
        for axis in ((0, 2), (0, 1)):
            now, want = (copies * tokens).sum(axis=axis), tokens.sum(axis=axis) * size / whole
            factor = np.where(now > 0, want / np.maximum(now, 1e-300), 1)
            copies = copies * (factor[None, :, None] if axis == (0, 2) else factor[None, None, :])
        if np.abs(copies - before).max() < tol:
            break
    return np.where(tokens > 0, to_sources(copies), 0)


def corpus_cells(df: DataFrame, key: str, text: str, source: str, lang: str, topic_key: str, topics: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, lang, topic, n_tokens) of all documents with a source, as a written table.

    topics(topic_key, topic) is unique by its key. Texts are counted where they lie; only the counts are joined.
    """
    labelled = df.where(F.col(source).isNotNull()).select(F.col(key), F.col(source).alias("source"), language(F.col(lang)).alias("lang"), F.col(topic_key).alias("topic_key"), F.col(text).alias("text"))
    counted = count_tokens(spread(labelled), "text", [key, "source", "lang", "topic_key"], vocabulary)
    # null keys are spread over the tasks; they match no topic
    salt = F.when(F.col("topic_key").isNull(), 1 + F.pmod(F.xxhash64(key), F.lit(997))).otherwise(0).cast("int")
    of = topics.where(F.col(topic_key).isNotNull()).select(F.col(topic_key).alias("topic_key"), F.lit(0).alias("salt"), "topic")
    joined = counted.withColumn("salt", salt).join(of, ["topic_key", "salt"], "left")
    return materialize(joined.select(key, "source", "lang", F.coalesce("topic", F.lit("unknown")).alias("topic"), "n_tokens"), "corpus")


def mix(corpus: DataFrame, targets: DataFrame, key: str, size: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(selection, report). targets(source, target_share, max_repeats); size in tokens, by default the corpus's.

    selection: key, source, n_tokens, copies (one row per selected document). report: one row per target source.
    """
    spark = corpus.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"]) if r["max_repeats"] is not None else 1) for r in targets.where("source is not null and target_share is not null").limit(MAX_SOURCES + 1).collect()}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(wanted)
    topics = corpus.groupBy("topic").agg(F.sum("n_tokens").alias("n"))
    whole = topics.agg(F.sum("n")).first()[0] or 0
    common = [r["topic"] for r in topics.where(F.col("n") >= TOPIC_SHARE * whole).collect()]
    labelled = corpus.where(F.col("source").isin(sources)).withColumn("topic", F.when(F.col("topic").isin(common), F.col("topic")).otherwise("other")) if sources else corpus.where("false")
    cells = labelled.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).collect()
    langs, tops = sorted({r["lang"] for r in cells}), sorted({r["topic"] for r in cells})
    tokens = np.zeros((len(sources), max(1, len(langs)), max(1, len(tops))))
    for r in cells:
        tokens[sources.index(r["source"]), langs.index(r["lang"]), tops.index(r["topic"])] = r["n"]
    size = float(whole if size is None else size)
    share, cap = (np.array([wanted[s][i] for s in sources], float) for i in (0, 1))
    available = tokens.sum(axis=(1, 2))
    asked = share * size
    copies = rake(tokens, asked, cap)
    # out of reach: the raking has put every cell of the source at its cap, and that is still too little
    at_cap = ((copies >= cap[:, None, None]) | (tokens == 0)).all(axis=(1, 2))
    reachable = ~(at_cap & (available * cap < asked))
    goal = np.where(reachable, asked, available * cap)

    rows = [(sources[s], langs[a], tops[t], int(np.floor(copies[s, a, t] + 1e-9)), float(max(0.0, copies[s, a, t] - np.floor(copies[s, a, t] + 1e-9)))) for s, a, t in zip(*np.nonzero(tokens))]
    of_cell = F.broadcast(spark.createDataFrame(rows or [("", "", "", 0, 0.0)], "source string, lang string, topic string, base int, part double"))
    uniform = (F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
    scored = labelled.join(of_cell, ["source", "lang", "topic"]).select(key, "source", "n_tokens", "base", F.when(F.col("part") > 1e-9, uniform / F.col("part")).alias("v"))
    # tokens of the whole copies, and tokens that one more copy would add by bin of v
    sums = scored.groupBy("source", F.when(F.col("v") < 2, F.floor(F.col("v") * BINS)).alias("bin")).agg(F.sum(F.col("n_tokens") * F.col("base")).alias("whole"), F.sum("n_tokens").alias("n")).collect()
    base, more = np.zeros(len(sources)), np.zeros((len(sources), 2 * BINS))
    for r in sums:
        s = sources.index(r["source"])
        base[s] += r["whole"]
        if r["bin"] is not None:
            more[s, r["bin"]] += r["n"]
    reach = np.concatenate([base[:, None], base[:, None] + np.cumsum(more, axis=1)], axis=1)
    bins = np.abs(reach - goal[:, None]).argmin(axis=1)
    limit = spark.createDataFrame([(s, int(b) / BINS) for s, b in zip(sources, bins)] or [("", 0.0)], "source string, upto double")
    copies_of = F.col("base") + F.when(F.col("v") < F.col("upto"), 1).otherwise(0)
    selection = scored.join(F.broadcast(limit), "source").select(key, "source", "n_tokens", copies_of.alias("copies")).where("copies > 0")
    got = reach[np.arange(len(sources)), bins]
    all_got = float(got.sum())
    report = [(s, float(share[i]), int(cap[i]), int(available[i]), int(got[i]), float(got[i] / all_got) if all_got else 0.0, float(got[i] / size) if size else 0.0, bool(reachable[i] and (size > 0 or share[i] <= 0))) for i, s in enumerate(sources)]
    schema = "source string, target_share double, max_repeats int, available_tokens long, selected_tokens long, reached_share double, share_of_size double, reachable boolean"
    return selection, spark.createDataFrame(report, schema)
