"""Language of web pages by Bayesian fusion of text, markup, address and host.

Text: naive Bayes over hashed letter trigrams, learned from labelled documents. Markup (the declared language) and address (the host
name's ending, and a leading path part): likelihoods P(value | language) from grouped sums of text posteriors over all pages, smoothed
towards the belief that a value that names a language means it. Host: a prior from the text posteriors of the host's other pages,
smoothed towards its registered domain's and that towards the whole table's, by grouped sums. A page's own text never counts twice:
it is left out of every sum that is held against it.

Defined results: null and empty pages have no text evidence and get what the rest says; a null address has no host and no ending; an
address of numbers is its own domain; repeated rows are scored one by one; equal probabilities go to the language that is last in
the alphabet; an empty table gives no rows; without labelled documents every language list is empty and the result is null; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

BUCKETS = 1 << 15
#: Kinds of evidence with a value: the declared language, the host's ending and the leading part of the path.
VALUES = ("declared", "ending", "path")
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_OTHER = re.compile(r"[\W\d_]+")
# Labels that stand before a country's code and are no names of owners.
SECOND_LEVEL = "ac co com edu gob gov gub go info ltd me mil ne net nom or org plc sch".split()


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the letter trigrams of the folded text."""
    s = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(1_000_003) + c[1:-1]) * np.uint64(1_000_033) + c[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def visible(page: str | None) -> str:
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def learn_trigrams(docs: DataFrame, max_rows: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (languages, buckets) from at most about max_rows labelled documents, picked by a hash of doc_id."""
    marked = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    share = min(1.0, max_rows / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, s in sums.items():
            on = np.nonzero(s)[0]
            yield pa.record_batch({"lang": [lang] * len(on), "bucket": pa.array(on), "n": pa.array(s[on])})

    rows = marked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages times BUCKETS at most
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        of = rows[rows["lang"] == lang]
        table[i, of["bucket"].to_numpy()] += of["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def identify(pages: DataFrame, langs: list[str], loglik: np.ndarray, temper: float = 0.1, host_weight: float = 5.0, value_weight: float = 5.0, trust: float = 0.8) -> DataFrame:
    """page_id, lang, probability, declared, suffix, host. temper: exponent of the text likelihood, as trigrams overlap and depend on each other.

    host_weight and value_weight: pages that what lies above a host, and the first belief in a value, are worth. trust: that belief.
    """
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("probability", "double"), ("declared", "string"), ("suffix", "string"), ("host", "string"))])
    scratch, n = Scratch(pages.sparkSession, "language"), len(langs)

    def text_posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page in b.column("html").to_pylist():
                grams = trigrams(visible(page))
                z = temper * loglik[:, grams].sum(axis=1) if len(grams) else np.zeros(n)
                z = np.exp(z - z.max())
                out.append(z / z.sum())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["page_id", *VALUES, "host", "domain", "text_p"])

    known = F.array(*map(F.lit, langs))
    filled = lambda c: F.when(c != "", c)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    size = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(size - k + 1, F.lit(1)), F.lit(k)), ".")
    national = (size > 2) & (F.length(F.get(labels, size - 1)) == 2) & F.get(labels, size - 2).isin(SECOND_LEVEL)
    domain = F.when(host.rlike(r"^[0-9.]+$|^\["), host).when(national, last(3)).otherwise(last(2))
    ending = F.when(~host.rlike(r"[0-9]$|\]$"), F.regexp_extract(host, r"\.([^.]+)$", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), filled(declared).alias("declared"), filled(ending).alias("ending"), filled(path).alias("path"), host.alias("host"), domain.alias("domain"), "html")
    text = ", ".join(f"{c} string" for c in (*VALUES, "host", "domain"))
    scored = scratch.save(given.mapInArrow(text_posterior, f"page_id long, {text}, text_p array<double>"), "scored")

    sums = F.array(*[F.sum(F.col("text_p")[i]) for i in range(n)])
    total = scored.agg(F.count("*").alias("rows"), sums.alias("s")).first()  # one row
    rows, whole = max(1, total["rows"]), [x or 0.0 for x in total["s"]]
    base = [(x + 1.0) / (rows + n) for x in whole]

    def of_group(name: str) -> DataFrame:
        """name, its sums by language and its rows; one row for each value."""
        t = scored.filter(F.col(name).isNotNull()).groupBy(name).agg(sums.alias(f"{name}_s"), F.count("*").alias(f"{name}_n"))
        return scratch.save(t, f"by-{name}")

    j = scored
    for name in ("host", "domain", *VALUES):
        t = of_group(name)
        j = j.join(broadcast_if_small(t, t.count(), 40 + 8 * n + 8), name, "left")
    logs = []
    for i, lang in enumerate(langs):
        own = F.col("text_p")[i]
        d = (F.col("domain_s")[i] - own + host_weight * base[i]) / (F.col("domain_n") - 1 + host_weight)
        h = (F.col("host_s")[i] - own + host_weight * d) / (F.col("host_n") - 1 + host_weight)
        z = F.log(F.greatest(own, F.lit(1e-12))) + F.log(F.greatest(h, F.lit(1e-6)))
        for name in VALUES:
            believed = F.when(F.col(name) == lang, trust).when(F.array_contains(known, F.col(name)), (1 - trust) / max(1, n - 1)).otherwise(F.col(f"{name}_n") / float(rows))
            p = (F.col(f"{name}_s")[i] - own + value_weight * believed) / (F.lit(whole[i]) - own + value_weight)
            z = z + F.when(F.col(name).isNull(), 0.0).otherwise(F.log(F.greatest(p, F.lit(1e-9))))
        logs.append(F.struct(z.alias("z"), F.lit(lang).alias("lang")))
    j = j.withColumn("zs", F.array(*logs)).withColumn("best", F.array_max("zs"))
    p = F.lit(1.0) / F.aggregate("zs", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("best.z")))
    named = lambda c: F.when(F.array_contains(known, F.col(c)), F.col(c))
    return j.select("page_id", F.col("best.lang").alias("lang"), p.alias("probability"), named("declared").alias("declared"), F.coalesce(named("ending"), named("path")).alias("suffix"), "host")
