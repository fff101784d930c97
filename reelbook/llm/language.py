"""Language of texts by Bayesian fusion of evidence.

The posterior of a language is the product of: the likelihood of the text under a model of character trigrams; the likelihood
of the language its markup declares, from how often markup and text agree; and the prior of its host, smoothed by that of the
address suffix, smoothed by that of all rows. Models and priors are counts over all rows, made by grouped aggregation.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, prepare, texts_of
from reelbook.session import stage

#: Declared languages with a model of their own at most, those most rows declare; all others share one model, ``OTHER``.
MOST_LANGUAGES = 32
OTHER, UNDETERMINED = "other", "und"
#: Codes that name no language.
_NO_LANGUAGES = ("und", "mul", "zxx", "mis")
#: Trigrams are counted in this many buckets; a text weighs as at most so many independent ones.
BUCKETS, MOST_WEIGHT = 1 << 13, 60.0
#: Rows a suffix or host counts as in the prior above it.
PRIOR_ROWS = 20.0
#: Prior of a text in no language, whatever its host.
NO_LANGUAGE = 1e-3
#: Posterior from which a row is accepted.
ACCEPT = 0.5
_UNREAD = re.compile(r"<(script|style)\b", re.IGNORECASE)
_UNREAD_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}


def without_markup(text: str) -> str:
    """Text with a space for each script, style sheet, comment and tag; what is opened and never closed stays text.

    One pass: every search goes on behind the last one, and a closing mark once not found is not looked for again.
    """
    kept: list[str] = []
    missing: set[str] = set()
    done = 0
    at = text.find("<")
    while at >= 0:
        end = -1
        if (opened := _UNREAD.match(text, at)) and (name := opened[1].lower()) in _UNREAD_END and name not in missing:
            closed = _UNREAD_END[name].search(text, opened.end())
            end = closed.end() if closed else -1
            if not closed:
                missing.add(name)
        elif text.startswith("<!--", at) and "-->" not in missing:
            end = text.find("-->", at + 4) + 3
            if end < 3:
                end = -1
                missing.add("-->")
        if end < 0:
            end = text.find(">", at) + 1
            if not end:
                break
        kept.append(text[done:at])
        done, at = end, text.find("<", end)
    kept.append(text[done:])
    return " ".join(kept)


def _trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the letters of a text; other characters part words."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2C00)))
    code = np.where(letter, code, 32)
    code = code[(code != 32) | np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    code = np.concatenate([[32], code, [32]])
    key = (code[:-2] * 0x1F123BB5 + code[1:-1] * 0x5BD1E995 + code[2:] * 0x2545F491) & 0x7FFFFFFF
    return ((key ^ (key >> 15)) * 0x2C1B3C6D >> 12 & (BUCKETS - 1))[code[1:-1] != 32]


def _primary(code: Column) -> Column:
    """Language of a code such as ``en-US``, in small letters; null if it names none."""
    found = F.lower(F.regexp_extract(F.coalesce(code, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9_-]*)?\s*$", 1))
    return F.when((found != "") & ~found.isin(*_NO_LANGUAGES), found)


def _languages(found: DataFrame, most: int) -> tuple[str, ...]:
    """The ``most`` languages most rows declare, and ``OTHER`` if there are more."""
    counts = found.where(F.col("declared").isNotNull()).groupBy("declared").agg(F.count("*").alias("n"))
    listed = [r[0] for r in counts.orderBy(F.desc("n"), "declared").limit(most + 1).collect()]
    return (*sorted(listed[:most]), *[OTHER] * (len(listed) > most))


def evidence(rows: DataFrame, *, key: str, text: str, declared: str | None = None, url: str | None = None, host: str | None = None,
             markup: bool = False) -> DataFrame:
    """_key, text, declared (language of the markup or of a column), host, suffix of each row."""
    address = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)) if url else (
        F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit(""))
    said = _primary(F.col(declared).cast("string")) if declared else F.lit(None).cast("string")
    if markup:
        said = F.coalesce(said, _primary(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*+=\s*+(?:[\"']\s*+)?+([A-Za-z0-9_-]+)", 1)))
    return rows.select(
        F.col(key).cast("bigint").alias("_key"), F.col(text).cast("string").alias("text"),
        said.alias("declared"), address.alias("host"), F.regexp_extract(address, r"\.([^.]+)$", 1).alias("suffix"),
    )


def _trigram_counts(found: DataFrame, markup: bool, languages: tuple[str, ...]) -> np.ndarray:
    """Counts of trigram buckets per language that rows declare, over all of them."""
    out = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for said, text in texts_of(batch, "text", "declared"):
                seen[languages.index(said)] += np.bincount(_trigrams(without_markup(text) if markup else text), minlength=BUCKETS)
        cells = np.flatnonzero(seen)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen.ravel()[cells])], schema=out)

    rows = found.where(F.col("declared").isNotNull()).select("declared", "text").mapInArrow(run, "cell int, n bigint")
    counts = np.zeros(len(languages) * BUCKETS)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # (MOST_LANGUAGES + 1) * BUCKETS at most
        counts[r["cell"]] = r["n"]
    return counts.reshape(len(languages), BUCKETS)


def _likelihoods(found: DataFrame, counts: np.ndarray, markup: bool) -> DataFrame:
    """Adds ``text_ll``: log likelihood of the text per language, and last under no language (all trigrams alike)."""
    model = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    model = np.vstack([model, np.full(BUCKETS, -math.log(BUCKETS))])
    out = pa.schema([("_key", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("text_ll", pa.list_(pa.float64())), ("n_trigrams", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for k, said, host, suffix, text in texts_of(batch, "text", "_key", "declared", "host", "suffix"):
                    grams = _trigrams(without_markup(text) if markup else text)
                    n = len(grams)
                    total = model @ np.bincount(grams, minlength=BUCKETS) if n else np.zeros(len(model))
                    yield k, said, host, suffix, total * (min(n, MOST_WEIGHT) / max(n, 1)), n

        yield from batches_of(out, rows(), size=2000)

    return found.mapInArrow(run, "_key bigint, declared string, host string, suffix string, text_ll array<double>, n_trigrams bigint")


def _best(scores: Column, languages: tuple[str, ...]) -> Column:
    """Language with the highest score, the first of equals."""
    return F.element_at(F.array(*map(F.lit, (*languages, UNDETERMINED))), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify_languages(rows: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str | None = None, url: str | None = None,
                       host: str | None = None, markup: bool = False, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """Language of every row: key, language, posterior, text_language, declared, accepted.

    Languages are those that rows declare, by the first part of their code (``en`` of ``en-US``). The ``most_languages`` most
    declared have a model each, all others one together, named ``other``. A language whose declared rows have no letters has no
    model and counts as undeclared; where no row declares a language all are undetermined and none is accepted.

    ``declared`` names a column, ``markup`` reads ``<html lang=...>`` of the text, ``url`` or ``host`` gives the host and its
    suffix. A text without letters is undetermined whatever is declared, and not accepted; nor is one whose posterior is below
    ``ACCEPT``. Null hosts share one prior. Repeated keys are rows of their own.
    """
    prepare(rows.sparkSession)
    found = evidence(rows, key=key, text=text, declared=declared, url=url, host=host, markup=markup)
    languages = _languages(found, most_languages)
    said = F.when(F.col("declared").isin(*languages), F.col("declared"))
    found = found.withColumn("declared", F.when(F.col("declared").isNotNull(), F.coalesce(said, F.lit(OTHER))) if OTHER in languages else said)
    counts = _trigram_counts(found, markup, languages)
    trained = counts.sum(axis=1) > 0
    languages, counts = tuple(l for l, t in zip(languages, trained) if t), counts[trained]
    found = found.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")))
    scored = stage(_likelihoods(found, counts, markup).withColumn("text_language", F.when(F.col("n_trigrams") > 0, _best(F.col("text_ll"), languages)).otherwise(UNDETERMINED)), "language")
    all_ = (*languages, UNDETERMINED)

    # Markup: how often a text of each language declares each, smoothed by one row.
    pairs = {(r[0], r[1]): r[2] for r in scored.where(F.col("n_trigrams") > 0).groupBy("text_language", "declared").agg(F.count("*")).collect()}
    said = {d: [math.log((pairs.get((l, d), 0) + 1) / (sum(pairs.get((l, x), 0) for x in languages) + len(languages))) for l in all_] for d in languages}
    markup_ll = F.coalesce(*[F.when(F.col("declared") == d, F.array(*map(F.lit, v))) for d, v in said.items()], F.array(*[F.lit(0.0)] * len(all_)))

    # Priors: rows per language of all, of a suffix, of a host, each smoothed by the one above.
    each = [F.sum(F.when(F.col("text_language") == l, 1).otherwise(0)).alias(l) for l in all_]
    whole = scored.agg(*each).first()
    total = sum(x or 0 for x in whole) + len(all_)
    base = [((x or 0) + 1) / total for x in whole]
    by_suffix = scored.groupBy("suffix").agg(*each)
    size = sum((F.col(l) for l in all_), F.lit(0.0))
    suffixes = by_suffix.select("suffix", F.array(*[(F.col(l) + PRIOR_ROWS * p) / (size + PRIOR_ROWS) for l, p in zip(all_, base)]).alias("_above"))
    hosts = scored.groupBy("host", "suffix").agg(*each).join(suffixes, "suffix").select(
        "host", F.array(*[(F.col(l) + PRIOR_ROWS * F.col("_above")[i]) / (size + PRIOR_ROWS) for i, l in enumerate(languages)], F.lit(NO_LANGUAGE)).alias("prior")
    )
    joined = scored.join(stage(hosts, "hosts"), "host")
    scores = F.transform(F.arrays_zip("text_ll", markup_ll.alias("m"), "prior"), lambda z: z["text_ll"] + z["m"] + F.log(z["prior"]))
    fused = joined.withColumn("_scores", scores)
    top = F.array_max("_scores")
    posterior = 1 / F.aggregate("_scores", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    known = F.col("n_trigrams") > 0
    named = fused.withColumn("language", F.when(known, _best(F.col("_scores"), languages)).otherwise(UNDETERMINED)).withColumn("posterior", F.when(known, posterior).otherwise(0.0))
    return named.select(
        F.col("_key").alias(key), "language", "posterior", "text_language", "declared",
        ((F.col("language") != UNDETERMINED) & (F.col("posterior") >= ACCEPT)).alias("accepted"),
    )
