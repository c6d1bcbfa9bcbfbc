"""Language of texts, and of the stretches of mixed texts, by rank-order profiles.

A profile lists a language's most frequent n-grams by rank.  A text's own n-grams
are ranked by frequency and compared to each profile by out-of-place distance, on
a logarithmic scale of ranks so that short texts, whose ranks are mostly ties,
weigh a profile's first places most.  Candidate languages are those written in
the text's main script.  Whole batches of texts are compared at once with NumPy.

Profiles are fitted on a bounded sample of labelled rows (`sample_rows`); labels
may be wrong as long as most of them are right.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip
from corpusloom.operators.skew import spread

# ISO 639-2 codes (terminological and bibliographic) of the ISO 639-1 codes.
THREE_LETTERS = {
    "en": ("eng",), "zh": ("zho", "chi", "cmn"), "ja": ("jpn",), "de": ("deu", "ger"), "fr": ("fra", "fre"),
    "es": ("spa",), "pt": ("por",), "ru": ("rus",), "th": ("tha",), "it": ("ita",), "nl": ("nld", "dut"),
    "ko": ("kor",), "ar": ("ara",), "pl": ("pol",), "tr": ("tur",), "vi": ("vie",), "id": ("ind",), "hi": ("hin",),
}
# ISO 15924 codes and the classes of letters they are written in.
SCRIPT_CLASSES = {"Latn": (1,), "Cyrl": (2,), "Thai": (3,), "Hans": (4,), "Hant": (4,), "Hani": (4,), "Jpan": (4, 5)}
LATIN, CYRILLIC, THAI, HAN, KANA, OTHER = 1, 2, 3, 4, 5, 6
#: Letters of one class count for so much text, Latin letters being 1.
WEIGHT = np.array([0, 1.0, 1.0, 1.0, 3.0, 2.0, 1.0])
ORDERS = (2, 3)
SLOTS = 1 << 20
TOP = 400
FAR = 14.0
#: Profiles whose distances differ by less than this share of the largest distance can't be told apart by one text.
CLOSE = 0.02
LOG = np.log2(1 + np.arange(TOP)).astype(np.float32)



@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of each code point up to U+3FFFF; 0 is no letter.  Marks count as letters of their script."""
    out = np.zeros(0x40000, dtype=np.uint8)
    names = (("LATIN", LATIN), ("CYRILLIC", CYRILLIC), ("THAI", THAI), ("CJK", HAN), ("HIRAGANA", KANA), ("KATAKANA", KANA))
    for cp in range(0x10000):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            name = unicodedata.name(c, "")
            out[cp] = next((k for n, k in names if name.startswith(n)), OTHER)
    out[0x300:0x370] = LATIN  # combining marks
    out[0xFF21:0xFF5B] = np.where(out[0xFF21:0xFF5B] == OTHER, LATIN, out[0xFF21:0xFF5B])
    out[0x3005] = HAN
    out[0x30FC] = KANA
    out[0x20000:0x40000] = HAN
    return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, blanks between words, with the text's number and letter class of each place.

    Every text begins and ends with a blank.
    """
    joined = "\x00" + " \x00".join(t.lower().replace("\x00", " ") for t in texts) + " "
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = letter_classes()
    cls = table[np.minimum(a, len(table) - 1)]
    cls[a >= len(table)] = 0
    cut = a == 0
    letter = cls > 0
    keep = letter | cut
    keep[1:] |= letter[:-1] & ~cut[1:]
    unit = np.cumsum(cut, dtype=np.int64)[keep] - 1
    cls = cls[keep]
    codes = np.where(cls > 0, a[keep], 32).astype(np.uint32)
    return codes, unit, cls


def gram_hashes(codes: np.ndarray, unit: np.ndarray, n: int, running: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams from those of order n-1, and which lie within one text."""
    if running is None:
        h = codes * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    else:
        h = (running[:-1] ^ (running[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
    return h, unit[: len(h)] == unit[n - 1 :]


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (order in the upper half) of all texts together, with counts."""
    codes, unit, _ = codes_of(texts)
    keys, h = [], None
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h, ok = gram_hashes(codes, unit, n, h)
        if n not in ORDERS:
            continue
        first = codes[: len(h)]
        k = h[ok & ((n > 1) | (first != 32))]
        keys.append(k.astype(np.int64) | (np.int64(n) << 32))
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Profiles:
    """Ranked n-grams of several languages, laid out for lookup."""

    def __init__(self, langs: list[str], scripts: list[str], grams: list[tuple[str, int, float]]):
        """`grams`: (language, key, place); a place is log2(1 + rank)."""
        self.langs, self.scripts = list(langs), list(scripts)
        at = {x: i for i, x in enumerate(self.langs)}
        keys = np.array(sorted({g[1] for g in grams}), dtype=np.int64)
        self.place = np.full((len(keys) + 1, len(langs)), FAR, dtype=np.float32)
        if grams:
            where = np.searchsorted(keys, np.array([g[1] for g in grams], dtype=np.int64))
            self.place[where, [at[g[0]] for g in grams]] = [g[2] for g in grams]
        self.keys = keys
        self.slots = np.zeros((max(ORDERS) + 1, SLOTS), dtype=np.int32)
        self.extra: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in ORDERS:
            own = np.flatnonzero((keys >> 32) == n)
            low = keys[own] & 0xFFFFFFFF
            self.slots[n][low % SLOTS] = own + 1
            # N-grams whose slot another one holds are found by search.
            lost = self.slots[n][low % SLOTS] != own + 1
            order = np.argsort(low[lost])
            self.extra[n] = (low[lost][order].astype(np.uint32), own[lost][order])
        self.allowed = np.zeros((7, len(langs)), dtype=bool)
        for i, s in enumerate(self.scripts):
            for k in SCRIPT_CLASSES.get(s, (OTHER,)):
                self.allowed[k, i] = True
        # A script of several classes is told by its own one: kana is never Chinese, but Han may be Japanese.
        self.allowed[0, :] = False

    def __reduce__(self):
        grams = [(self.langs[j], int(self.keys[i]), float(self.place[i, j])) for i, j in zip(*np.nonzero(self.place[:-1] < FAR), strict=True)]
        return Profiles, (self.langs, self.scripts, grams)

    def scripts_of(self, unit: np.ndarray, cls: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Main class of each text (0: no letters) and that class's share of its letters."""
        w = np.bincount(unit * 7 + cls, minlength=n * 7).reshape(n, 7) * WEIGHT
        kana = w[:, KANA] > 0.1 * w[:, HAN]
        w[:, KANA] += np.where(kana, w[:, HAN], 0)
        w[:, HAN] = np.where(kana, 0, w[:, HAN])
        total = w.sum(axis=1)
        main = w.argmax(axis=1)
        main[total == 0] = 0
        return main, np.divide(w[np.arange(n), main], total, out=np.zeros(n), where=total > 0)

    def classify_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), confidence, letters, margin and near languages of each text.

        Near languages, a bit mask, are those within `CLOSE` of the best.  The confidence is 1 where the script leaves one language (times the script's
        share), else from the gap between the nearest and the next profile.
        """
        n = len(texts)
        codes, unit, cls = codes_of(texts)
        main, share = self.scripts_of(unit, cls, n)
        letters = np.bincount(unit[cls > 0], minlength=n)
        options = self.allowed[main]
        count = options.sum(axis=1)
        lang = np.where(count == 1, options.argmax(axis=1), -1)
        conf, margin = np.where(count == 1, share, 0.0), np.where(count == 1, 1.0, 0.0)
        near = np.where(count == 1, 1 << np.maximum(lang, 0), 0)
        for k in np.unique(main[count > 1]):
            todo = main == k
            group = np.flatnonzero(self.allowed[k])
            own = todo[unit]
            dist, seen = self.distances(codes[own], unit[own], n, group)
            known = todo & (seen > 0)
            two = np.partition(dist[known], 1, axis=1)
            gap = (two[:, 1] - two[:, 0]) / FAR
            lang[known] = group[dist[known].argmin(axis=1)]
            margin[known] = gap
            near[known] = ((dist[known] <= two[:, :1] + CLOSE * FAR) << group).sum(axis=1)
            conf[known] = share[known] / (1 + np.exp(-40 * gap))
        return lang, conf, letters, margin, near

    def classify(self, texts: list[str], batch_chars: int = 400_000):
        """`classify_some` over any number of texts, in batches that fit the processor's cache."""
        if not texts:
            return np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
        ends = np.cumsum([len(t) + 2 for t in texts]) // batch_chars
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        parts = [self.classify_some(texts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def distances(self, codes: np.ndarray, unit: np.ndarray, n: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean out-of-place distance of each text's n-grams to the profiles of `group`, and the number of known n-grams."""
        found, h = [], None
        g = len(self.keys)
        low = (self.keys & 0xFFFFFFFF).astype(np.uint32)
        for order in range(1, max(ORDERS) + 1):
            if len(codes) < order:
                break
            h, ok = gram_hashes(codes, unit, order, h)
            if order not in ORDERS:
                continue
            at = self.slots[order][h & np.uint32(SLOTS - 1)]
            ok &= at > 0
            pos = np.flatnonzero(ok)
            at = at[pos] - 1
            same = low[at] == h[pos]
            found.append(unit[pos[same]] * (g + 1) + at[same])
            names, index = self.extra[order]
            if len(names):
                rest = pos[~same]
                k = np.minimum(np.searchsorted(names, h[rest]), len(names) - 1)
                hit = names[k] == h[rest]
                found.append(unit[rest[hit]] * (g + 1) + index[k[hit]])
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        dist, seen = np.full((n, len(group)), FAR), np.zeros(n, int)
        if not len(keys):
            return dist, seen
        keys = keys.astype(np.uint32) if (n + 1) * (g + 1) < 2**32 else keys
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.concatenate([first, [len(keys)]]))
        keys = keys[first].astype(np.int64)
        u = keys // (g + 1)
        gram = keys - u * (g + 1)
        # By text, then the most frequent n-grams first.
        most = int(times.max())
        bits, wide = most.bit_length(), int(g + 1).bit_length()
        if n.bit_length() + bits + wide < 63:
            packed = (((u << bits) | (most - times)) << wide) | gram
            packed.sort()
            u, gram = packed >> bits + wide, packed & ((1 << wide) - 1)
            top = packed >> wide  # text and frequency
        else:
            order = np.lexsort((gram, -times, u))
            u, gram, times = u[order], gram[order], times[order]
            top = u * (most + 1) + most - times
        k = np.arange(len(u))
        new = np.concatenate([[True], u[1:] != u[:-1]])
        start = np.flatnonzero(new)
        begin = np.repeat(start, np.diff(np.concatenate([start, [len(u)]])))
        # Equally frequent n-grams share the first of their ranks.
        tie = np.maximum.accumulate(np.where(np.concatenate([[True], top[1:] != top[:-1]]), k, 0))
        keep = k - begin < TOP
        u, gram, rank = u[keep], gram[keep], (tie - begin)[keep]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        far = self.place[:, group][gram]
        away = far >= FAR
        far = np.abs(far - LOG[rank][:, None])
        far[away] = FAR
        at = u[start]
        seen[at] = np.diff(np.concatenate([start, [len(u)]]))
        dist[at] = np.add.reduceat(far, start, axis=0) / seen[at][:, None]
        return dist, seen


# Marked-up parts that are no language: code, tags, addresses, and short bracketed or quoted terms.
ASIDE = re.compile(
    r"```.*?(?:```|$)|`[^`\n]*`|<[a-zA-Z/][^>\n]{0,80}>|https?://\S+|\S+@\S+"
    r"|[\[(（【「『《«“„\"][^\[\]()（）「」『』《》«»“”„\"\n.!?。！？]{1,48}[\])）】」』》»”“\"]",
    re.S,
)
MARKED = re.compile(r"[`<@\[(（【「『《«“„\"]|://")
# Where a sentence-like unit ends: a line end, closing marks with what closes behind them, or a free-standing separator.
UNIT_END = re.compile(r"[\n.!?…。！？|/](?:(?<=\n)\n*|(?<=[。！？])[.!?…。！？]*[\"”’»」』)）\]]*|(?<=[.!?…])[.!?…。！？]*[\"”’»」』)）\]]*(?![^\s\u0e00-\U0010ffff])|(?<= [|/])(?= ))")
THAI_EDGE = re.compile(r"(?<=[\u0e00-\u0e7f])(?=\s*[^\W\d_\u0e00-\u0e7f])|(?<=[^\W\d_\u0e00-\u0e7f])(?=\s*[\u0e00-\u0e7f])|(?<=[^\W\d_\u0e00-\u0e7f][.!?:])(?=\s*[\u0e00-\u0e7f])")
THAI_CHAR = re.compile("[\u0e00-\u0e7f]")
OTHER_CHAR = re.compile(r"[^\W\d_\u0e00-\u0e7f]")
SEEN = re.compile(r"\w")
THREE_WORDS = re.compile(r"(?:[^\W\d_]{2,}[^\w]+(?:[\w]{1,2}[^\w]+)*){2}[^\W\d_]{2,}")
SCRIPTLESS = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of the sentence-like units of a text; asides are blanked out of `words`."""
    plain = ASIDE.sub(lambda m: " " * (m.end() - m.start()), text) if MARKED.search(text) else text
    cuts = [0, *(m.end() for m in UNIT_END.finditer(plain))]
    if cuts[-1] < len(plain):
        cuts.append(len(plain))
    if THAI_CHAR.search(plain) and OTHER_CHAR.search(plain):
        cuts = sorted({*cuts, *(m.end() for m in THAI_EDGE.finditer(plain))})
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = plain[a:b]
        if SEEN.search(piece):
            out.append((a, b, piece))
    return out


def is_sentence(words: str) -> bool:
    """Whether a unit is long enough to be a sentence by itself and not a mere term."""
    if SCRIPTLESS.search(words):
        return len(SCRIPTLESS.findall(words)) >= 6
    return THREE_WORDS.search(words) is not None


def segment_languages(profiles: Profiles, texts: list[str]) -> list[list[tuple[int, int, int, float, bool]]]:
    """Stretches (start, end, language number, confidence, has a whole sentence) of each text.

    A unit that can't tell its language, or is no whole sentence, goes with the
    unit before it (the first ones: after it) among the languages near it; adjacent
    units of one language form one stretch.
    """
    parts = [units(t) if t else [] for t in texts]
    number: dict[str, int] = {}  # equal units are compared once
    order = [number.setdefault(w, len(number)) for p in parts for _, _, w in p]
    lang, conf, _, margin, near = (x[order].tolist() if order else [] for x in profiles.classify(list(number)))
    out, k = [], 0
    for p in parts:
        n = len(p)
        own = range(k, k + n)
        k += n
        seen = {*lang[k - n : k]} - {-1}
        if len(seen) < 2:
            x = seen.pop() if seen else -1
            c = conf[k - n : k]
            out.append([(p[0][0], p[-1][1], x, max(c), True)] if x >= 0 else [])
            continue
        whole = [is_sentence(w) for _, _, w in p]
        sure = [lang[i] if i_whole and lang[i] >= 0 and margin[i] >= CLOSE else None for i, i_whole in zip(own, whole, strict=True)]
        if n == 1 or not any(x is not None for x in sure):
            best = [(len(p[j][2]), lang[i]) for j, i in enumerate(own) if lang[i] >= 0]
            if not best:
                out.append([])
                continue
            if n == 1:
                sure[0] = best[0][1]
            else:
                votes: dict[int, int] = {}
                for length, x in best:
                    votes[x] = votes.get(x, 0) + length
                sure = [max(votes, key=lambda x: (votes[x], -x))] * n
        held = next(x for x in sure if x is not None)
        stretch: list[tuple[int, int, int, float, bool]] = []
        for (a, b, _), i, x, w in zip(p, own, sure, whole, strict=True):
            held = held if x is None else x
            good = w and (x is not None or bool(near[i] >> held & 1))
            c = conf[i] if x is not None else 0.5
            if stretch and stretch[-1][2] == held:
                s = stretch[-1]
                stretch[-1] = (s[0], b, held, (s[3] * (s[1] - s[0]) + c * (b - a)) / (s[1] - s[0] + b - a), s[4] or good)
            else:
                stretch.append((a, b, held, c, good))
        out.append(stretch)
    return out


def label_code(label: Column, codes: list[tuple[str, str]]) -> Column:
    """The language code that a label names in any notation, else null.

    Accepts the code, its region forms (en-GB, ja_JP), the English name and the
    three-letter codes, in any letter case and with blanks around.
    """
    key = F.lower(strip(F.coalesce(label, F.lit(""))))
    head = F.regexp_replace(key, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", "$1")
    names: dict[str, str] = {}
    for code, name in codes:
        names |= {x: code for x in (code.lower(), name.lower(), *THREE_LETTERS.get(code, ()))}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.try_element_at(m, head))


def read_codes(language_codes: DataFrame) -> list[tuple[str, str, str]]:
    """(code, name, script) of the languages that may occur: a fixed, small table."""
    return [tuple(r) for r in language_codes.select("code", "name", "script").distinct().orderBy("code").collect()]


def fit_profiles(labelled: DataFrame, codes: list[tuple[str, str, str]], sample_rows: int = 12_000, size: int = 4_000) -> Profiles:
    """Profiles of `size` n-grams per language from rows (text, lang).

    `sample_rows` bounds the labelled rows used: if there are more, those with the
    smallest hashes are taken.  Labels in any notation are understood; rows without
    a usable label don't count.  A language without rows has an empty profile and
    can only be found by its script.
    """
    ok = labelled.select("text", label_code(F.col("lang"), [(c, n) for c, n, _ in codes]).alias("lang")).where("lang is not null and text is not null")
    n = ok.count()
    if n > sample_rows:
        least = int(2**64 * sample_rows / n) - 2**63
        ok = ok.where(F.xxhash64("text") < F.lit(least))
    ok = ok.distinct()  # a text with a third of the rows is one text

    def grams(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                keys, times = count_grams(part["text"].tolist())
                yield pd.DataFrame({"lang": lang, "key": keys, "n": times})

    counted = spread(ok).mapInPandas(grams, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    best = counted.withColumn("r", first).where(F.col("r") <= size).collect()  # languages x size
    rows = [(x["lang"], x["key"], float(np.log2(x["r"]))) for x in best]
    return Profiles([c[0] for c in codes], [c[2] for c in codes], rows)


def detect(df: DataFrame, profiles: Profiles, text_col: str, keep: list[str], label_col: str | None = None) -> DataFrame:
    """(*keep, lang, confidence) of each row's whole text.

    `label_col`, a language code or null, is believed unless the text is clearly
    nearer to another language.  A text without letters has a null language and
    confidence 0.
    """
    cols = list(dict.fromkeys([*keep, *([label_col] if label_col else []), text_col]))
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = shared.value
        names = np.array([*p.langs, None], dtype=object)
        for pdf in batches:
            lang, conf, _, _, near = p.classify([t if t is not None else "" for t in pdf[text_col]])
            if label_col:
                at = pdf[label_col].map({x: i for i, x in enumerate(p.langs)}).fillna(-1).astype(int).to_numpy()
                lang = np.where((at >= 0) & (near >> np.maximum(at, 0) & 1 == 1), at, lang)
            out = pdf[keep].copy()
            out["lang"], out["confidence"] = names[lang], conf
            yield out

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return spread(df.select(*cols)).mapInPandas(run, schema)


STRETCHES = "id string, seg_idx int, start int, `end` int, lang string, confidence double, whole boolean"


def stretches(records: DataFrame, profiles: Profiles, mixed_only: bool = False) -> DataFrame:
    """(id, seg_idx, start, end, lang, confidence, whole): the language stretches of each segment's content.

    Places are code points.  `whole` says that the stretch holds a whole sentence.
    Segments without letters have no stretch.  `mixed_only` leaves out the segments
    whose whole sentences are in fewer than two languages.
    """
    rows = records.where(F.col("id").isNotNull()).select("id", F.posexplode("segments").alias("seg_idx", "s")).select("id", "seg_idx", F.col("s.content").alias("content"))
    shared = records.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = shared.value
        for pdf in batches:
            found = segment_languages(p, [t if t is not None else "" for t in pdf["content"]])
            out = []
            for i, k, st in zip(pdf["id"], pdf["seg_idx"], found, strict=True):
                if not mixed_only or len({x[2] for x in st if x[4]}) > 1:
                    out += [(i, k, a, b, p.langs[x], c, w) for a, b, x, c, w in st]
            yield pd.DataFrame(out, columns=["id", "seg_idx", "start", "end", "lang", "confidence", "whole"])

    return spread(rows.where("content is not null")).mapInPandas(run, STRETCHES)


def fit_on(documents: DataFrame, language_codes: DataFrame, **kw) -> Profiles:
    """Profiles of the languages of `language_codes` from the labelled documents."""
    return fit_profiles(documents.select("text", "lang"), read_codes(language_codes), **kw)


def mislabelled(df: DataFrame, profiles: Profiles, codes: list[tuple[str, str, str]], tbl: str, id_col: str, at: str | None = None) -> DataFrame:
    """(tbl, rec_id, seg_idx, lang) of rows whose label is missing or not the text's language.

    With `at`, only the row with the latest such time of each id counts.
    """
    code = label_code(F.col("lang"), [(c, n) for c, n, _ in codes])
    extra = [at] if at else []
    d = df.select(F.col(id_col).cast("string").alias("rec_id"), *extra, code.alias("label"), "text")
    found = detect(d, profiles, "text", ["rec_id", *extra, "label"], "label")
    if at:
        found = found.groupBy("rec_id").agg(F.max(F.struct(at, "lang", "label")).alias("m")).select("rec_id", "m.lang", "m.label")
    return found.where("lang is not null and not (label <=> lang)").select(F.lit(tbl).alias("tbl"), "rec_id", F.lit(0).alias("seg_idx"), "lang").distinct()


def wrong_languages(documents: DataFrame, oasst1: DataFrame, records: DataFrame, language_codes: DataFrame, **kw) -> DataFrame:
    """(tbl, rec_id, seg_idx, lang): texts with a missing or wrong label, and the languages of mixed segments."""
    codes = read_codes(language_codes)
    p = fit_on(documents, language_codes, **kw)
    mixed = stretches(records, p, mixed_only=True).where("whole").select(F.lit("training_records").alias("tbl"), F.col("id").alias("rec_id"), "seg_idx", "lang").distinct()
    return (
        mislabelled(documents, p, codes, "documents", "doc_id")
        .unionByName(mislabelled(oasst1, p, codes, "oasst1", "message_id", "ingested_at"))
        .unionByName(mixed)
    )
