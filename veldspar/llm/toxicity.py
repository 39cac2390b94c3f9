"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lowers case, maps homoglyphs (Cyrillic, Greek, full width, mathematical) to Latin letters, drops
zero-width marks and reads digits and signs as letters where a letter follows (``1d10t``, ``$cum``). Hits
start at a word's start; each word counts its heaviest term. Hits inside an exception phrase (``trash can``)
don't count. The score is the weight of all hits per 100 words.

The lexicon is a short list of English terms, plus terms learned from labelled rows: words and word
beginnings whose share among toxic rows is far above that among others of the language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.runtime import ensure_importable

#: Terms of any language's text, whole words.
SEED = {
    w: 1.0
    for w in (
        "idiot idiots idiotic moron morons moronic loser losers scum scumbag pathetic worthless trash clown "
        "clowns disgusting stupid imbecile imbeciles cretin dumbass dimwit halfwit lowlife degenerate vermin "
        "filth bastard bastards bitch bitches asshole assholes retard retarded bullshit shithead fuck fucking "
        "fucker motherfucker whore slut cunt twat wanker jackass dickhead subhuman scumbags arschloch "
        "hurensohn schlampe missgeburt connard connasse salope enculé pendejo gilipollas cabrón imbécil"
    ).split()
}
#: Phrases whose words are harmless together.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "trash day", "idiot proof",
    "idiot-proof", "class clown", "clown fish", "rodeo clown", "circus clown", "sore loser", "pathetic fallacy",
    "stupid simple", "pond scum", "soap scum", "worthless check", "cock and bull",
)
#: At least so much weight per 100 words, and in all, makes a document toxic.
THRESHOLD, LEAST_WEIGHT = 0.3, 1.0
#: Labelled rows that the lexicon is learned from, at most, of each kind (in order of a hash of the id).
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 12_000
#: A learned term is in so large a share of a language's toxic rows, is so much likelier there, and has such length.
SUPPORT, LEAST_RATIO, LEAST_LETTERS, PREFIXES = 0.02, 12.0, 3, (4, 5, 6)

ADDED = ("n_words", "n_hits", "score", "toxic")

_HOMOGLYPHS = {
    "аɑα𝐚": "a", "ЬЪ": "b", "сϲ": "c", "ԁ": "d", "еєҽε": "e", "ɡ": "g", "һ": "h", "іıɩι": "i", "ј": "j", "кκ": "k",
    "ӏ": "l", "м": "m", "пո": "n", "оοօσ": "o", "рρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "тτ": "t", "υսц": "u",
    "ѵν": "v", "ѡԝω": "w", "хχ": "x", "уγ": "y", "ᴢ": "z",
}
_TABLE: dict[int, str | None] = {ord(c): v for k, v in _HOMOGLYPHS.items() for c in k}
_TABLE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
for _c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
    _plain = unicodedata.normalize("NFKC", chr(_c)).lower()
    if len(_plain) == 1 and _plain.isascii():
        _TABLE[_c] = _plain
_SIGNS = str.maketrans("0134578@$!|", "oieastbasii")
_SIGN_RUN = re.compile(r"[0134578@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def _ranges(codes: list[int], gap: int = 64) -> str:
    """A character class of few ranges that holds all codes (and what lies in gaps); a long one is slow to match."""
    out = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c - out[-1][1] > gap:
            out.append([c, c])
        out[-1][1] = c
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in out) + "]"


#: Whether a text may hold a sign of ``_TABLE``.
_STRANGE = re.compile(_ranges(sorted(_TABLE)))


def fold(text: str) -> str:
    """Text as it is matched; ``lower`` twice, since a mapped sign may be a capital."""
    text = text.lower()
    if not text.isascii() and _STRANGE.search(text):
        text = text.translate(_TABLE)
    return _SIGN_RUN.sub(lambda m: m.group().translate(_SIGNS), text)


class Matcher:
    """Automaton over whole words, word beginnings (``term*``) and exception phrases."""

    def __init__(self, terms: list[tuple[str | None, str, float]], exceptions: tuple[str, ...] = EXCEPTIONS):
        """``terms``: (language or None for any, term, weight)."""
        found: dict[str, list] = {}
        for lang, term, weight in terms:
            prefix = term.endswith("*")
            entry = found.setdefault(fold(term.rstrip("*")), [{}, {}, False])
            at = entry[prefix]
            at[lang] = max(weight, at.get(lang, 0.0))
        for phrase in exceptions:
            found.setdefault(fold(phrase), [{}, {}, False])[2] = True
        self.automaton = ahocorasick.Automaton()
        for term, entry in found.items():
            if term:
                self.automaton.add_word(term, (len(term), *entry))
        if len(self.automaton):
            self.automaton.make_automaton()

    def score(self, text: str, lang: str | None) -> tuple[int, int, float]:
        """Words, hits, and their weight."""
        text = fold(text)
        n_words = len(text.split())
        if not len(self.automaton):
            return n_words, 0, 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        size = len(text)
        for end, (length, whole, prefix, exception) in self.automaton.iter(text):
            begin = end - length + 1
            if begin and text[begin - 1].isalnum():
                continue
            ends = end + 1 == size or not text[end + 1].isalnum()
            if exception and ends:
                spared.append((begin, end))
            weight = max(prefix.get(lang, 0.0), prefix.get(None, 0.0))
            if ends:
                weight = max(weight, whole.get(lang, 0.0), whole.get(None, 0.0))
            if weight > hits.get(begin, 0.0):
                hits[begin] = weight
        if spared and hits:
            # sorted by beginning, and the farthest end so far: a hit is spared if a phrase begun by then goes on
            spared.sort()
            starts, ends = [a for a, _ in spared], list(accumulate((z for _, z in spared), max))
            hits = {p: w for p, w in hits.items() if not (k := bisect_right(starts, p)) or ends[k - 1] < p}
        return n_words, len(hits), math.fsum(hits.values())


def _features(text: str) -> set[str]:
    words = {w for w in _WORD.findall(fold(text)) if len(w) >= LEAST_LETTERS}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def _near_keys(text: str) -> tuple[int, int]:
    """Two min-hashes of the text's runs of three words; equal for copies, mostly equal for near copies."""
    words = text.lower().split()
    runs = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return tuple(min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1 for seed in (1, 2))


def learn(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, str, float]]:
    """Terms from labelled rows (``labels``: doc_id, toxic), with weights from their log odds ratio, at most 1.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` distinct texts are read, whole. Rows with a null label or text
    don't count; without any toxic row there are no terms. The number of terms depends on the sample's bound
    and ``SUPPORT`` alone, not on the corpus.
    """
    ensure_importable(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = (
        marked.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC)
        .unionByName(marked.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    )
    rows = docs.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id")

    def keys(batches):
        for batch in batches:
            two = [_near_keys(t) for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in ("lang", "text", "toxic")]
            cols += [pa.array([k[n] for k in two], type=pa.int64()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "text", "toxic", "k0", "k1"])

    # copies and near copies would make the words of one text look typical
    rows = (
        rows.select("lang", "text", "toxic").mapInArrow(keys, "lang string, text string, toxic int, k0 long, k1 long")
        .dropDuplicates(["k0"]).dropDuplicates(["k1"]).select("lang", "text", "toxic")
    )

    def count(batches):
        found: dict[str | None, list[Counter]] = {}
        for batch in batches:
            for lang, text, toxic in zip(*(batch.column(c).to_pylist() for c in range(3))):
                at = found.setdefault(lang, [Counter(), Counter()])[int(toxic == 1)]
                at.update(_features(text))
                at[""] += 1
        out = [(lang, t, two[1][t], two[0][t]) for lang, two in found.items() for t in two[0].keys() | two[1].keys()]
        names = ("lang", "term", "toxic", "clean")
        for k in range(0, len(out), 100_000):
            cols = list(zip(*out[k : k + 100_000]))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=list(names))

    counts = (
        rows.mapInArrow(count, "lang string, term string, toxic long, clean long")
        .groupBy("lang", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # one pass over the counts: totals are the rows of the empty term
    kept = counts.where((F.col("term") == "") | ((F.col("toxic") >= 5) & (F.col("toxic") > 0.2 * F.col("clean")))).collect()
    totals = {r.lang: (r.toxic, r.clean) for r in kept if r.term == ""}
    terms = []
    for r in kept:
        n_toxic, n_clean = totals[r.lang]
        if not r.term or r.toxic < max(5, SUPPORT * n_toxic):
            continue
        ratio = (r.toxic + 0.5) / (n_toxic + 1) / ((r.clean + 0.5) / (n_clean + 1))
        if ratio >= LEAST_RATIO and r.clean <= 0.002 * n_clean:
            terms.append((r.lang, r.term, min(1.0, math.log(ratio) / 4)))
    return sorted(terms, key=str)


def score_documents(
    docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, terms=None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default ``doc_id``) with ``n_words``, ``n_hits``, ``score`` and ``toxic``, for every row.

    With ``labels`` the lexicon is learned first (see :func:`learn`). Null or empty text has no words, score 0
    and isn't toxic; a null language meets the terms of any language and those learned under null. A score equal
    to ``threshold`` is toxic. Texts of any length are matched whole, in time linear in it (but for sorting the
    exception phrases found). Repeated rows give repeated results; an empty table gives an empty one. Kept columns called like an added one are
    dropped. One scan and no shuffle; the lexicon is bounded whatever the corpus.
    """
    ensure_importable(docs.sparkSession)
    added = list(ADDED)
    keep = [c for c in (keep or ["doc_id"]) if c.lower() not in added]
    if terms is None:
        terms = [(None, w, v) for w, v in SEED.items()]
        if labels is not None:
            terms += learn(docs, labels)
    carried = [c for c in keep if c not in ("text", "lang")]

    def run(batches):
        matcher = Matcher(terms)
        for batch in batches:
            out = []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                words, hits, weight = matcher.score(text.as_py() or "", lang)
                score = 100.0 * weight / max(words, 1)
                out.append((words, hits, round(score, 6), weight >= LEAST_WEIGHT and score >= threshold))
            cols = list(zip(*out)) if out else [()] * 4
            types = (pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, type=t) for c, t in zip(cols, types)], names=[*keep, *added]
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_words int, n_hits int, score double, toxic boolean"
    return docs.select(*carried, "text", "lang").mapInArrow(run, schema)
