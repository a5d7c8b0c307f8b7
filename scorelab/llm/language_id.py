"""Language identification by Bayesian fusion of independent evidence.

log P(language | row) = log prior(host) + text likelihood + log P(declared | language)
                        + log P(suffix | language), up to a constant.

* Text: character trigrams of the words, counted by language over every labelled document.
* Declared language and address suffix: confusion tables against the text's own reading, counted
  by grouped aggregation over all rows, with add-one smoothing.
* Host prior: language counts of a host, smoothed by those of its domain, smoothed by those of all
  rows; each level is one grouped aggregation of the level below.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, join_side, record, release, require_at_most, table, written
from scorelab.llm.token_ids import in_slices

#: Trigrams are counted by a hash of ``FINE`` bits; a model has 2^bits counters a language, at least
#: ``SPARE`` times as many as there are different trigrams (so that about one in ``SPARE`` shares its counter) up
#: to 2^``FINE``. A block of a model has as many languages as fit ``CELLS`` counters.
FINE, LEAST_BITS, SPARE, CELLS = 24, 17, 8, 1 << 25
#: Different language labels; there are some 8,000 languages.
MAX_LANGUAGES = 10_000
#: Whether a character is a letter, for the basic plane; the others are looked up when met.
_PLANE = 0x10000


def _letters(codes: np.ndarray) -> np.ndarray:
    if not hasattr(_letters, "table"):
        _letters.table = np.array([chr(i).isalpha() for i in range(_PLANE)])
    far = codes >= _PLANE
    if not far.any():
        return _letters.table[codes]
    out = _letters.table[np.where(far, 32, codes)]
    out[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    return out


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (``FINE`` bits) of the character trigrams of all words, text by text, and how many the texts up
    to each have. A word of n letters has n trigrams, a space standing at either end."""
    line = " " + " ".join(texts).lower() + " "
    sizes = np.array([len(t.lower()) if not t.isascii() else len(t) for t in texts], np.int64)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    c = np.where(letter, codes, np.uint32(32))
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA6B) ^ c[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum(sizes + 1)  # the place after each text's separator
    return (h >> np.uint32(32 - FINE)).astype(np.int64), np.searchsorted(at, ends)


def label(lang: Column) -> Column:
    """A declared language as the model has it: the primary part in lower case (en-US, EN and en are one)."""
    text = lang.cast("string")
    main = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    return F.when(main != "", main).otherwise(F.lower(F.trim(text)))


def count_trigrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", at_most: int = 1_000_000) -> DataFrame:
    """(lang, fine, n) over all rows with a language. Tasks add up counts by language and pass on what they
    have at ``at_most`` different ones."""
    out = [("lang", pa.string()), ("fine", pa.int32()), ("n", pa.int64())]

    def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, of = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(of, n, len(distinct)).astype(np.int64)

    def job(batches: Iterator[pa.RecordBatch]):
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            for first, last in in_slices(texts):
                by: dict[str, list[str]] = {}
                for t, lang in zip(texts[first:last], langs[first:last], strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    grams = trigrams(some)[0]
                    new = added(grams, np.ones(len(grams), np.int64))
                    old = seen.get(lang)
                    seen[lang] = new if old is None else added(*(np.concatenate(x) for x in zip(old, new, strict=True)))
            if sum(len(k) for k, _ in seen.values()) > at_most:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    def flush(seen: dict):
        for lang, (keys, n) in seen.items():
            yield record(out, [[lang] * len(keys), keys.astype(np.int32), n])

    view = doc_view(docs, id_col, text_col, lang=lang_col).withColumn("lang", label(F.col("lang"))).where("lang is not null and lang <> ''")
    return arrow_map(view, job, "lang string, fine int, n long").groupBy("lang", "fine").agg(F.sum("n").alias("n"))


class Block:
    """Log likelihoods of trigrams under some languages: (language, counter)."""

    def __init__(self, counts: np.ndarray, total: np.ndarray, met: int, unknown: float, bits: int):
        logp = np.log((counts + 0.5) / (total[:, None] + 0.5 * met))
        self.logp, self.bits = np.maximum(logp, unknown - 2).astype(np.float32), bits

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods and the trigrams of each text."""
        grams, ends = trigrams(texts)
        grams >>= FINE - self.bits
        bounds = np.concatenate([[0], ends])
        out = np.zeros((len(texts), len(self.logp)))
        for k, logp in enumerate(self.logp):
            total = np.concatenate([[0.0], np.cumsum(logp[grams], dtype=np.float64)])
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return out, np.diff(bounds)


class TextModel:
    """The languages, and their likelihoods in blocks of languages that are built one at a time."""

    def __init__(self, counts: DataFrame, cells: int = CELLS):
        self.counts = counts
        sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()  # a row a language
        require_at_most(len(sizes), MAX_LANGUAGES, "languages")
        self.languages = sorted(r.lang for r in sizes)
        self.total = np.array([dict(map(tuple, sizes))[lang] for lang in self.languages], float)
        different = counts.select("fine").distinct().count()
        self.bits = min(FINE, max(LEAST_BITS, (SPARE * different).bit_length()))
        self.met = max(1, counts.select(F.shiftright("fine", FINE - self.bits)).distinct().count())
        #: what a text in none of the languages would get: every trigram a quarter as likely as any met one
        self.unknown = math.log(1 / (4 * self.met))
        self.size = max(1, cells >> self.bits)

    def blocks(self) -> Iterator[Block]:
        for a in range(0, len(self.languages), self.size):
            some = self.languages[a : a + self.size]
            at = F.shiftright("fine", FINE - self.bits).alias("at")
            got = self.counts.where(F.col("lang").isin(some)).groupBy("lang", at).agg(F.sum("n").alias("n")).toPandas()
            counts = np.zeros((len(some), 1 << self.bits), np.int64)
            counts[got["lang"].map({x: i for i, x in enumerate(some)}).to_numpy(int), got["at"].to_numpy(int)] = got["n"].to_numpy()
            yield Block(counts, self.total[a : a + self.size], self.met, self.unknown, self.bits)


def train_text(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """The text model of all labelled rows. Its number of counters follows the number of different trigrams;
    what the driver holds at a time is a block of at most ``CELLS`` counters."""
    return TextModel(written(count_trigrams(docs, lang_col, text_col), "trigrams"))


def _scored(df: DataFrame, block: Block, text: Column) -> Column:
    """Log likelihoods under a block's languages and the number of trigrams."""
    sent = df.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("struct<ll: array<double>, grams: long>")
    def job(texts: pd.Series) -> pd.DataFrame:
        release()
        texts, parts = texts.fillna("").tolist(), []
        for first, last in in_slices(texts):
            ll, n = sent.value.scores(texts[first:last])
            parts.append(pd.DataFrame({"ll": list(ll), "grams": n}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"ll": [], "grams": []})

    return job(text)


def likelihoods(df: DataFrame, model: TextModel, text: Column) -> DataFrame:
    """``df`` with _ll (log likelihood by language, relative to the best), _grams, _fit (mean log
    likelihood of a trigram under the best language). With several blocks of languages the texts are scored block
    by block, each block's numbers are written, and the rows' parts are put together."""
    if len(model.languages) <= model.size:
        out = df.withColumn("_t", _scored(df, next(model.blocks()), text))
        every, grams = F.col("_t")["ll"], F.col("_t")["grams"]
    else:
        out = written(df.withColumn("_n", F.monotonically_increasing_id()), "lang_rows")
        for i, block in enumerate(model.blocks()):
            part = written(out.select("_n", _scored(out, block, text).alias("_t")), "lang_block").select("_n", F.col("_t")["ll"].alias(f"_l{i}"), F.col("_t")["grams"].alias("_g"))
            out = out.join(part if not i else part.drop("_g"), "_n")
        n_blocks = -(-len(model.languages) // model.size)
        every, grams = F.concat(*[F.col(f"_l{i}") for i in range(n_blocks)]), F.col("_g")
        out = out.withColumn("_t", F.struct(every.alias("ll"), grams.alias("grams"))).drop("_n", "_g", *[f"_l{i}" for i in range(n_blocks)])
        every, grams = F.col("_t")["ll"], F.col("_t")["grams"]
    best = F.array_max(every)
    return out.withColumns({"_ll": F.transform(every, lambda x: x - F.array_max(F.col("_t")["ll"])), "_grams": grams,
                            "_fit": F.when(grams > 0, best / grams).otherwise(F.lit(0.0))}).drop("_t")


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _by_language(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, m): rows with a reading and, by language index, how many. Keys without any stay."""
    counted = rows.groupBy(*keys, "reading").agg(F.count("*").alias("n"))
    some = F.filter(F.collect_list(F.struct("reading", "n")), lambda x: x["reading"].isNotNull())  # at most one a language
    return counted.groupBy(*keys).agg(F.sum(F.when(F.col("reading").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.map_from_entries(some).alias("m"))


def _languages(k: int, value) -> Column:
    """An array with ``value(index)`` for each of k languages."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), value)


def _of(m: str, i: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(m), i), F.lit(0).cast("long"))


def host_priors(rows: DataFrame, languages: list[str], strength: float = 10.0) -> DataFrame:
    """(host, domain, _prior): log prior by language. ``rows``: host, domain, reading (index of
    the text's own language, null if it has no words). A host with n rows has n parts of its own
    evidence and ``strength`` of its domain's, a domain likewise of all rows'."""
    k = len(languages)
    hosts = _by_language(rows, "host", "domain")
    domains = _by_language(rows, "domain").select(F.col("domain").alias("_domain"), F.col("total").alias("_total"), F.col("m").alias("_m"))
    every = dict(map(tuple, rows.where("reading is not null").groupBy("reading").agg(F.count("*").alias("n")).collect()))  # a row a language
    base = _array([(every.get(i, 0) + 1.0) / (sum(every.values()) + k) for i in range(k)])
    domains = domains.select("_domain", _languages(k, lambda i: (_of("_m", i) + strength * F.get(base, i)) / (F.col("_total") + strength)).alias("_p"))
    prior = _languages(k, lambda i: F.log((_of("m", i) + strength * F.get("_p", i)) / (F.col("total") + strength)))
    return hosts.join(domains, hosts.domain.eqNullSafe(domains["_domain"])).select("host", prior.alias("_prior"))


def _confusion(rows: DataFrame, col: str, k: int) -> tuple[DataFrame, Column]:
    """((col, _e): log P(value | language) of every value met, the same of a value never met with a
    reading), with add-one smoothing over the values met."""
    met = rows.where(F.col(col).isNotNull() & F.col("reading").isNotNull())
    every = dict(map(tuple, met.groupBy("reading").agg(F.count("*").alias("n")).collect()))  # a row a language
    values = _by_language(met, col)
    different = met.select(col).distinct().count() + 1
    sums = [every.get(i, 0) + different for i in range(k)]
    whole = _array([float(x) for x in sums])
    return values.select(col, _languages(k, lambda i: F.log((_of("m", i) + 1) / F.get(whole, i))).alias("_e")), _array([-math.log(x) for x in sums])


def _with_evidence(df: DataFrame, col: str, logs: tuple[DataFrame, Column], k: int, out: str) -> DataFrame:
    """``df`` with the evidence of its value; null: none."""
    found = join_side(df, written(logs[0], "lang_values").withColumnRenamed("_e", out), col)
    return found.withColumn(out, F.when(F.col(col).isNull(), _array([0.0] * k)).otherwise(F.coalesce(out, logs[1])))


def identify(df: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column, domain: Column,
             strength: float = 10.0, temper: float = 0.2) -> DataFrame:
    """``df`` with lang_id, lang_p (posterior of lang_id), lang_text (the text's own reading),
    lang_fit (mean log likelihood of a trigram), lang_grams and lang_posterior.

    Trigrams of a text are not independent, so their sum is weighed by ``temper``. A text without
    words is judged by the other evidence alone; ties go to the first language by name. With no
    language known to the model lang_id is null. Texts are scored twice (once for the priors) so
    that no text is shuffled; the host priors are written and joined, adaptive execution splits a
    hot host.
    """
    k = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages])
    if not k:
        return df.withColumns({"lang_id": F.lit(None).cast("string"), "lang_p": F.lit(None).cast("double"), "lang_text": F.lit(None).cast("string"),
                               "lang_fit": F.lit(0.0), "lang_grams": F.lit(0).cast("long"), "lang_posterior": F.array().cast("array<double>")})
    base = df.withColumns({"_declared": label(declared), "_suffix": suffix.cast("string"), "_host": F.coalesce(host.cast("string"), F.lit("")), "_domain": F.coalesce(domain.cast("string"), F.lit(""))})
    reading = F.when(F.col("_grams") > 0, F.array_position("_ll", F.lit(0.0)).cast("int") - 1).alias("reading")
    slim = base.select(text.alias("_text"), "_declared", "_suffix", "_host", "_domain")
    seen = written(likelihoods(slim, model, F.col("_text")).select(F.col("_declared").alias("declared"), F.col("_suffix").alias("suffix"), F.col("_host").alias("host"), F.col("_domain").alias("domain"), reading), "lang_readings")
    priors = written(host_priors(seen, model.languages, strength).withColumnRenamed("host", "_host"), "lang_priors")
    joined = likelihoods(base, model, text).join(priors, "_host")
    for col, out in (("declared", "_said"), ("suffix", "_ends")):
        logs = _confusion(seen, col, k)
        joined = _with_evidence(joined, f"_{col}", (logs[0].withColumnRenamed(col, f"_{col}"), logs[1]), k, out)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.transform("_ll", lambda x: x * temper), "_prior"), add("_said", "_ends"))
    top = F.array_max("_total")
    out = joined.withColumn("_total", total).withColumn("_e", F.transform("_total", lambda x: F.exp(x - F.array_max("_total"))))
    out = out.withColumn("lang_posterior", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))
    return out.withColumns({
        "lang_id": names[F.array_position("_total", top).cast("int") - 1], "lang_p": F.array_max("lang_posterior"),
        "lang_text": F.when(F.col("_grams") > 0, names[F.array_position("_ll", F.lit(0.0)).cast("int") - 1]), "lang_fit": F.col("_fit"), "lang_grams": F.col("_grams"),
    }).drop("_declared", "_suffix", "_host", "_domain", "_ll", "_grams", "_fit", "_prior", "_said", "_ends", "_total", "_e")


def rejected(model: TextModel, declared: Column, sure: float = 0.99, least_grams: int = 60) -> Column:
    """Which rows of ``identify`` a corpus should not keep: their declared language is one of the
    model's and another one is sure beyond it, or the text fits no language of the model. Texts
    of fewer than ``least_grams`` trigrams, or with no declared language, are kept."""
    enough = F.col("lang_grams") >= least_grams
    declared = label(declared)
    other = declared.isin(*model.languages) & (F.col("lang_id") != declared) & (F.col("lang_p") >= sure)
    return F.coalesce(enough & (other | (F.col("lang_fit") < F.lit(model.unknown))), F.lit(False))


_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible(html: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return unescape(_HIDDEN.sub(" ", html)) if html else ""


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` with _text, _lang (declared in the markup), _site (host), _root (domain), _end
    (address suffix). Null html or url: no evidence of that kind."""

    @F.pandas_udf("string")
    def shown(html: pd.Series) -> pd.Series:
        return html.map(visible)

    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    site = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    root = F.regexp_extract("_site", r"([^.]+\.[^.]+)$", 1)
    end = F.regexp_extract("_site", r"\.([^.]+)$", 1)
    return pages.withColumns({"_text": shown("html"), "_lang": F.nullif(declared, F.lit("")), "_site": F.nullif(site, F.lit(""))}).withColumns(
        {"_root": F.nullif(root, F.lit("")), "_end": F.nullif(end, F.lit(""))}
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, lang_id, lang_p, lang_text, lang_grams, declared, host. The text model
    is counted over all documents."""
    model = train_text(table(spark, sf_dir, "documents"))
    pages = page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = identify(pages, model, F.col("_text"), F.col("_lang"), F.col("_end"), F.col("_site"), F.col("_root"))
    return found.select("page_id", "lang_id", F.round("lang_p", 6).alias("lang_p"), "lang_text", "lang_grams", F.col("_lang").alias("declared"), F.col("_site").alias("host"))
