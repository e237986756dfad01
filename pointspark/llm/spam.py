"""Keyword-stuffed, link-list and product-tag pages.

1. Rank-frequency curve of every page: terms are ranked by frequency in a window; log frequency is regressed on log rank. Slope,
   residual, head share (of the two commonest terms), and the page's divergence (Kullback-Leibler) and surprise (cross entropy)
   against the term distribution of prose in its language. A link, and a tag beside others, is a term too. The language
   is recognised from the text: its script and, where languages share one, its function words; a page is prose if these
   have their usual share.
2. Candidates are the pages on which one of the figures is CANDIDATE robust deviations (median, MAD) off that of prose of the same language
   and of similar length, on the side of stuffing. No other page is found.
3. A candidate is found if more than half of its characters are links, tags (three or more) or stuffed lines. A line is stuffed
   if its terms' log-odds, between the most extreme candidates (against all pages of their language and length) and all
   other pages, sum above zero; the found pages replace the most extreme ones and this is repeated ROUNDS times. These weights are
   the one input beside the curves.
4. Terms on fewer than MIN_PAGES pages have no weight. A candidate with a large head, made of words rather than of signs and
   numbers, is found too if repeats of such terms are more than half of its terms.

Words that mix scripts are spelled with the Latin letters that the others look like before they are counted. Texts are cut into
terms once, by an Arrow kernel: it is half as dear as the same patterns as nested expressions, and what it hands on
are terms with their counts, so that nothing downstream moves single tokens.

All statistics cover all documents; nothing is trained on given labels. The language model keeps the LANGUAGE_TERMS commonest terms of each
language and counts all others as one class. Fixed lists are those of link syntax and function words.

Defined cases: NULL, empty and blank texts are never flagged; pages below MIN_TERMS terms (a link counts three) aren't
flagged; a single link never makes a page a link list; repeated rows of an id count once; very long texts are
handled whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.session import cut

#: Last labels of host names that are links even without scheme or path.
HOST_ENDS = "example|test|invalid|com|org|net|info|biz|shop|store|online|site|io|co|ru|cn|de|fr|es|uk|jp"
#: Forms of links, plain, without scheme, and disguised.
LINK = (
    r"(?i)h(?:tt|xx)ps?://\S+"
    r"|(?<![\p{L}\p{N}])w ?w ?w ?\. ?\S+"
    r"|(?<!\S)[^\s\[({]{1,80}[\[({] ?(?:\.|dot) ?[\])}]\S+"
    rf"|(?<![\p{{L}}\p{{N}}_@.-])(?:[\p{{L}}\p{{N}}_-]++\.)+(?:{HOST_ENDS})(?![\p{{L}}\p{{N}}.])(?:/[^\s|,;)\]>]*+)?"
)
#: Encoded data: an unbroken run of so many characters has no terms.
BLOB = "[A-Za-z0-9+/=]{48,}"
TAG = r"#[\p{L}_][^\s#\x02]*+"
#: Tags that count as such in the text; directives of preprocessors don't.
COUNTED_TAG = r"(?<![&/])#(?!(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|warning|line|region|endregion)(?![\p{L}\p{N}_]))[\p{L}_][\p{L}\p{M}\p{N}_]*+(?:-[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*+)*+"
#: Letters of other scripts and the Latin ones that they (or their capitals) look like.
LOOKALIKES = ("аеорсухіјѕԁһкмтвнԛԝґαβεζηικμνορτυχ", "aeopcyxijsdhkmtbhqwrabeznikmvoptux")
MIXED = r"[a-z][\u0370-\u03ff\u0400-\u052f]|[\u0370-\u03ff\u0400-\u052f][a-z]"
INVISIBLE = "[\u0001-\u0003​‌‍⁠﻿­]"
MARK, END, CUT = "\u0001", "\u0002", "\u0003"
#: Where none of these is found there is no link either; searching them first spares most texts the dear pattern.
LINK_HINT = rf"(?i)h(?:tt|xx)ps?://|w ?w ?w ?\.|[\[({{] ?(?:\.|dot) ?[\])}}]|\.(?:{HOST_ENDS})"
#: Function words of languages that share a script, and the least share of terms that they have in prose.
WORDS = {
    "en": ("the of and to in is it that for you with on are", 0.15),
    "de": ("der die das und ist nicht mit ein ich zu den auf", 0.15),
    "fr": ("le les des est une dans que pour pas du et sur", 0.15),
    "es": ("el los las una por con para del que es y no", 0.15),
    "ru": ("в и не на что с по это как у из за от к так же но меня было", 0.08),
    "ar": ("في من على أن إلى لا هل ما هو عن مع ثم هذا التي كان", 0.08),
}
#: The same for scripts without spaces, by characters.
SIGNS = {"zh": ("的是了不在有我这吗就过那", 0.05), "ja": ("のにはをたてがでともかすし", 0.15)}
SCRIPTS = {"ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "latin": r"\p{Latin}"}
LATIN = ("en", "de", "fr", "es")
#: The term weights, and a language's terms, are broadcast up to so many rows, else joined by a shuffle.
BROADCAST_TERMS = 500_000
LANGUAGE_TERMS = 5_000
MIN_TERMS, MIN_LINKS, MIN_CURVE = 5, 3, 1
MAX_WEIGHT, MIN_PAGES, SHARE, EXTREME, CANDIDATE, ROUNDS = 4.0, 3, 0.5, 4.0, 3.0, 3
#: A page of rare terms: least share of its two commonest terms, least share of letters in its characters, least repeats of a term.
HEAD, LETTERS, REPEATS = 0.25, 0.85, 3
TEXTS_AT_ONCE = 1_000
PAGE = "lang string, evidence double, links int, link_chars int, tags int, tag_chars int, chars int, n int, letters int, terms array<string>, counts array<int>, segs array<struct<chars:int,tag_chars:int,at:array<int>,counts:array<int>>>"


class Tokenizer:
    """Cuts one text into links, lines or sentences, and terms."""

    def __init__(self) -> None:
        c = regex.compile
        self.invisible, self.hint, self.link, self.tag, self.counted = c(INVISIBLE), c(LINK_HINT), c(LINK), c(TAG), c(COUNTED_TAG)
        self.markup, self.blob, self.camel = c(r"</?[a-zA-Z][^>]{0,80}>"), c(BLOB), c(r"(?<=\p{Ll})(?=\p{Lu})|_")
        # a line ends at its break or behind a full stop; found by what it begins with, which is the fast way
        self.ends = re.compile(r"[.!?]\s+|[。！？؟]\s*|[\r\n]+")
        self.digits, self.word, self.mixed = c(r"\p{N}+"), c(rf"[\p{{L}}\p{{M}}0]+|{CUT}"), c(MIXED)
        self.scripts = {k: c(v) for k, v in SCRIPTS.items()}
        self.words = {k: frozenset(v.split()) for k, (v, _) in WORDS.items()}
        self.fold = str.maketrans(*LOOKALIKES)

    def lines(self, t: str) -> list[str]:
        out, last = [], 0
        for m in self.ends.finditer(t):
            at = m.start() + (t[m.start()] not in "\r\n")
            out.append(t[last:at])
            last = m.end()
        out.append(t[last:])
        return out

    def terms(self, s: str) -> list[str]:
        """Lower-case words; camel case and underscores separate, numbers are all alike."""
        if max(map(len, s.split()), default=0) >= 48:
            s = self.blob.sub(" ", s)
        low = s.lower()
        if s != low or "_" in s:
            low = self.camel.sub(" ", s).lower()
        found = self.word.findall(self.digits.sub("0", low))
        if not low.isascii() and self.mixed.search(low):
            found = [w.translate(self.fold) if self.mixed.search(w) else w for w in found]
        return found

    def language(self, counts: Counter, text: str) -> tuple[str, float]:
        """(language, share of its function words); the evidence is relative to the least share in prose."""
        n = sum(counts.values()) or 1
        script = "latin"
        if 10 * len(text.encode("ascii", "ignore")) < 9 * len(text):  # with fewer other letters a text is Latin
            long = {k: len(p.findall(text)) for k, p in self.scripts.items()}
            if long["ja"] > 0.1 * (long["ja"] + long["zh"]):
                long["ja"], long["zh"] = long["ja"] + long["zh"], 0
            script = max(long, key=long.get) if any(long.values()) else "other"
        if script in SIGNS:
            signs, least = SIGNS[script]
            return script, sum(text.count(ch) for ch in signs) / long[script] / least
        shares = {k: sum(counts[w] for w in self.words[k]) / n / WORDS[k][1] for k in (LATIN if script == "latin" else (script,)) if k in WORDS}
        best = max(shares, key=shares.get, default=script)  # without evidence a Latin text is compared with the first language
        return best, shares.get(best, 1.0)

    def page(self, text: str) -> tuple:
        t = self.invisible.sub("", text)
        links: list[int] = []
        if self.hint.search(t):
            t = self.link.sub(lambda m: links.append(m.end() - m.start()) or f" {MARK} ", t)
        tags = [len(g) for g in self.tag.findall(t)] if "#" in t else []
        plain = self.markup.sub(" ", t) if "<" in t else t
        lines = [(s, len("".join(s.split())) - s.count(MARK)) for s in self.lines(plain)]
        lines = [(s, n) for s, n in lines if n or MARK in s]
        # all lines are cut into terms at once, with a sign between them
        tokens = self.terms(f" {CUT} ".join(s for s, _ in lines))
        cuts = [-1, *[i for i, w in enumerate(tokens) if w == CUT], len(tokens)]
        parts = [Counter(tokens[a + 1 : b]) for a, b in zip(cuts, cuts[1:])] if lines else []
        whole = Counter(tokens)
        whole.pop(CUT, None)
        at = dict(zip(whole, range(len(whole))))
        segs = [(n, sum(map(len, self.counted.findall(s))) if "#" in s else 0, [at[w] for w in f], list(f.values())) for (s, n), f in zip(lines, parts)]
        lang, evidence = self.language(whole, plain)
        n = len(tokens) - max(len(lines) - 1, 0)
        letters = sum(map(len, tokens)) - whole["0"] - (len(tokens) - n)
        return lang, evidence, len(links), sum(links), len(tags), sum(tags), sum(n for _, n in lines) + sum(links), n, letters, list(whole), list(whole.values()), segs


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = chain.from_iterable(values)
    return pa.ListArray.from_arrays(ends, pa.array(np.fromiter(flat, np.int32, int(ends[-1])) if kind == pa.int32() else list(flat), type=kind))


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a page: language, visible characters, links, tags, terms with counts, and its lines or sentences with theirs."""
    rows = docs.where(F.trim(text) != "").groupBy(F.col(key).alias("doc")).agg(F.min(text).alias("t"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer()
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(start, TEXTS_AT_ONCE)
                pages = [tokenizer.page(t) for t in b.column(1).to_pylist()]
                cols = list(zip(*pages))
                flat = [s for segs in cols[11] for s in segs]
                inner = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), _lists([s[2] for s in flat], pa.int32()), _lists([s[3] for s in flat], pa.int32())], names=["chars", "tag_chars", "at", "counts"])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[11]])]).astype(np.int32)
                kinds = [pa.string(), pa.float64(), *[pa.int32()] * 7]
                arrays = [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)], _lists(cols[9], pa.string()), _lists(cols[10], pa.int32()), pa.ListArray.from_arrays(ends, inner)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "lang", "evidence", "links", "link_chars", "tags", "tag_chars", "chars", "n", "letters", "terms", "counts", "segs"])

    return rows.mapInArrow(cut_up, f"doc {docs.schema[key].dataType.simpleString()}, {PAGE}")


def page_terms(pages: DataFrame) -> DataFrame:
    """(doc, lang, evidence, term, f): a page's terms without numbers, its links and, beyond two, its tags."""
    marks = F.array(F.struct(F.lit(MARK).alias("term"), F.col("links").alias("f")), F.struct(F.lit(END).alias("term"), F.when(F.col("tags") >= MIN_LINKS, F.col("tags")).otherwise(0).alias("f")))
    words = F.transform(F.arrays_zip("terms", "counts"), lambda e: F.struct(e["terms"].alias("term"), e["counts"].alias("f")))
    return pages.select("doc", "lang", "evidence", F.explode(F.concat(words, marks)).alias("e")).select("doc", "lang", "evidence", "e.*").where((F.col("f") > 0) & (F.col("term") != "0"))


def language_model(terms: DataFrame) -> DataFrame:
    """(lang, term, logp): the commonest terms of each language's prose; term NULL stands for any other."""
    freq = terms.where(F.col("evidence") >= 1).groupBy("lang", "term").agg(F.sum("f").alias("f"))
    freq = cut(freq)
    total = freq.groupBy("lang").agg(F.sum("f").alias("all"), F.count("*").alias("kinds"))
    top = freq.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("f"), "term"))).where(F.col("r") <= LANGUAGE_TERMS).drop("r")
    known = top.join(total, "lang").select("lang", "term", F.log(F.col("f") / (F.col("all") + 1)).alias("logp"))
    kept = top.groupBy("lang").agg(F.sum("f").alias("kept"), F.count("*").alias("top"))
    rest = F.greatest(F.col("all") - F.col("kept"), F.lit(1)) / ((F.col("all") + 1) * F.greatest(F.col("kinds") - F.col("top"), F.lit(1)))
    return known.union(total.join(kept, "lang").select("lang", F.lit(None).cast("string"), F.log(rest)))


def fit_curves(ranked_terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, terms, vocabulary, slope, residual, head, entropy) of the pages of (doc, f), one row a term; ``keys`` hold doc."""
    order = W.partitionBy("doc").orderBy(F.desc("f"))
    rows = ranked_terms.withColumn("r", F.row_number().over(order))
    x, y, f = F.log("r"), F.log("f"), F.col("f")
    sums = [F.sum(c).alias(c) for c in ranked_terms.columns if c not in (*keys, "f")]
    fit = rows.groupBy(*keys).agg(
        F.sum("f").alias("terms"), F.count("*").alias("vocabulary"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.sum(F.when(F.col("r") <= 2, f)).alias("top"), F.sum(f * y).alias("fy"), *sums,
    )
    residual = F.sqrt(F.greatest(F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), F.lit(0.0)) / F.col("vocabulary"))
    n = F.col("terms")
    return fit.select(*keys, "terms", "vocabulary", F.coalesce("slope", F.lit(0.0)).alias("slope"), residual.alias("residual"), (F.col("top") / n).alias("head"), (F.log(n) - F.col("fy") / n).alias("entropy"), *[c for c in ranked_terms.columns if c not in (*keys, "f")])


def curves(pages: DataFrame) -> DataFrame:
    """(doc, lang, evidence, terms, vocabulary, slope, residual, head, divergence, surprise): the rank-frequency fit of every page."""
    terms = page_terms(pages)
    model = cut(language_model(terms))  # at most LANGUAGE_TERMS rows a language of the fixed lists, and one for each
    rest = model.where(F.col("term").isNull()).select("lang", F.col("logp").alias("rest"))
    known = terms.join(F.broadcast(model.where(F.col("term").isNotNull())), ["lang", "term"], "left").join(F.broadcast(rest), "lang", "left")
    # a language without prose has no model: its pages have no divergence
    rows = known.select("doc", "lang", "evidence", "f", (F.col("f") * F.coalesce("logp", "rest", F.lit(0.0))).alias("logp"))
    fit = fit_curves(rows, ["doc", "lang", "evidence"])
    surprise = -F.col("logp") / F.col("terms")
    return fit.select("doc", "lang", "evidence", "terms", "vocabulary", "slope", "residual", "head", (surprise - F.col("entropy")).alias("divergence"), surprise.alias("surprise"))


#: The side of each figure that stuffing is on.
SIDES = {"slope": -1, "residual": 1, "head": 1, "divergence": 1, "surprise": 1}


def extremes(fits: DataFrame, peers: DataFrame, sided: bool) -> DataFrame:
    """(doc, score): the largest robust deviation from the peers of the same language and of similar length; infinite without peers."""
    size = F.floor(F.log2("terms"))
    by = ["lang", "size"]
    fits, peers = fits.withColumn("size", size), peers.withColumn("size", size)
    middle = F.broadcast(peers.groupBy(*by).agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"{c}_mid") for c in SIDES]))  # languages times powers of two
    spread = peers.join(middle, by).groupBy(*by).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_mid")), 0.5, 1000).alias(f"{c}_mad") for c in SIDES])
    z = [(F.col(c) - F.col(f"{c}_mid")) / (1.4826 * F.col(f"{c}_mad") + 0.02) for c in SIDES]
    z = [x * side if sided else F.abs(x) for x, side in zip(z, SIDES.values())]
    return fits.join(middle, by, "left").join(F.broadcast(spread), by, "left").select("doc", F.coalesce(F.greatest(*z), F.lit(float("inf"))).alias("score"))


def candidate_pages(fits: DataFrame) -> DataFrame:
    """(doc, seed): pages whose curve is not that of prose; ``seed``: extreme even among all pages of its language and length."""
    odd = extremes(fits, fits.where(F.col("evidence") >= 1), True).where(F.col("score") > CANDIDATE).select("doc")
    seed = extremes(fits, fits, False).select("doc", (F.col("score") > EXTREME).alias("seed"))
    return odd.join(seed, "doc")


def _weights(bears: DataFrame, df: DataFrame, suspects: DataFrame, pages: int) -> DataFrame:
    """(term, w): log-odds of a term's pages among suspects against all others; bears: (doc, term) of candidates."""
    ds = bears.join(suspects.select("doc"), "doc", "left_semi").groupBy("term").agg(F.count("*").alias("ds"))
    counts = df.where(F.col("df") >= MIN_PAGES).join(ds, "term", "left").select("term", F.coalesce("ds", F.lit(0)).alias("ds"), (F.col("df") - F.coalesce("ds", F.lit(0))).alias("dr"))
    ns = suspects.count()
    odds = F.log((F.col("ds") + 0.5) / (ns + 1)) - F.log((F.col("dr") + 0.5) / (pages - ns + 1))
    w = F.when((F.col("ds") < MIN_PAGES) | (F.col("ds") < F.col("dr")), F.least(odds, F.lit(0.0))).otherwise(odds)
    return cut(counts.select("term", F.least(F.greatest(w, F.lit(-MAX_WEIGHT)), F.lit(MAX_WEIGHT)).alias("w")).where(F.col("w") != 0))


def stuffed_share(pages: DataFrame, lines: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc, share, n): the part of each candidate's characters in stuffed lines, links and tags; lines: (doc, seg, chars, tag_chars, term, f)."""
    few = weights.count() <= BROADCAST_TERMS
    by = ["doc", "seg", "chars", "tag_chars"]
    # tags in stuffed lines are counted with these
    stuffed = lines.join(F.broadcast(weights) if few else weights, "term").groupBy(*by).agg(F.sum(F.col("f") * F.col("w")).alias("w")).where(F.col("w") > 0).groupBy("doc").agg(F.sum("chars").alias("stuffed"), F.sum("tag_chars").alias("within"))
    linked = F.when(F.col("links") >= MIN_LINKS, F.col("link_chars")).otherwise(0)
    tagged = F.when(F.col("tags") >= MIN_LINKS, F.col("counted") - F.coalesce("within", F.lit(0))).otherwise(0)
    return pages.join(stuffed, "doc", "left").select("doc", ((F.coalesce("stuffed", F.lit(0)) + linked + tagged) / F.greatest("chars", F.lit(1))).alias("share"), (F.col("n") + 3 * F.col("links")).alias("n"))


def rare_pages(pages: DataFrame, bears: DataFrame, df: DataFrame) -> DataFrame:
    """(doc, share): candidates of words, most of whose terms repeat but are on too few pages to have a weight."""
    wordy = pages.where(F.col("seed") & (F.col("head") >= HEAD) & (F.col("letters") >= LETTERS * (F.col("chars") - F.col("link_chars")))).select("doc", "n")
    often = bears.where((F.col("f") >= REPEATS) & (F.col("term") != "0")).join(wordy, "doc")
    unknown = often.join(df.where(F.col("df") >= MIN_PAGES), "term", "left_anti")
    return unknown.groupBy("doc", "n").agg(F.sum("f").alias("f")).select("doc", (F.col("f") / F.col("n")).alias("share")).where(F.col("share") > SHARE)


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, share): the flagged pages."""
    all_pages = cut(segments(docs, key, text))
    fits = cut(curves(all_pages))
    picked = candidate_pages(fits).join(fits.select("doc", "head"), "doc")
    odd = cut(all_pages.join(picked, "doc"))
    bears = odd.select("doc", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("doc", F.col("e.terms").alias("term"), F.col("e.counts").alias("f"))
    # pages of each term that any candidate has; terms are distinct within a page's row, so nothing is counted twice
    df = all_pages.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = cut(df.join(bears.select("term").distinct(), "term", "left_semi"))
    lines = odd.select("doc", "terms", F.posexplode("segs").alias("seg", "s")).select("doc", "seg", "s.chars", "s.tag_chars", "terms", F.explode(F.arrays_zip("s.at", "s.counts")).alias("e"))
    lines = lines.select("doc", "seg", "chars", "tag_chars", F.element_at("terms", F.col("e.at") + 1).alias("term"), F.col("e.counts").alias("f"))
    counted = F.aggregate("segs", F.lit(0), lambda a, x: a + x["tag_chars"])
    slim = odd.select("doc", "chars", "links", "link_chars", "tags", counted.alias("counted"), "n", "letters", "head", "seed")
    shape = ((F.col("links") >= MIN_LINKS) & (F.col("link_chars") > SHARE * F.col("chars"))) | ((F.col("tags") >= MIN_LINKS) & (F.col("counted") > SHARE * F.col("chars")))
    rare = cut(rare_pages(slim, bears, df))
    suspects, pages = cut(slim.where(F.col("seed") | shape).select("doc")), all_pages.count()
    for _ in range(ROUNDS):
        stuffed = stuffed_share(slim, lines, _weights(bears, df, suspects, pages)).where((F.col("share") > SHARE) & (F.col("n") >= MIN_TERMS)).select("doc", "share")
        suspects = cut(stuffed.union(rare).groupBy("doc").agg(F.max("share").alias("share")))
    return suspects.withColumnRenamed("doc", key)
