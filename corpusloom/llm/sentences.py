"""Sentence boundaries across languages and scripts.

Characters are tagged as boundary or inside by a linear-chain model and Viterbi
decoding.  Emission scores are log odds: for marks with a meaning of their own they
are weights of the mark, its neighbours and lists of abbreviations; where a mark says
nothing (ellipses, blanks in scripts without marks) they are log likelihood ratios of
the letters before and behind, counted on text stripped of its punctuation: letters at
proven ends and starts of sentences against letters inside.  How often such a place is
a boundary, and how often after another one, is not known from labels; both are
estimated by expectation maximisation over all places of the documents and are the
chain's transitions.  Only a sequence with letters or digits in every sentence is allowed.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.skew import cut_lineage, spread

# Abbreviations that never end a sentence before a capital letter.
NEVER = frozenset(
    """mr mrs ms dr prof rev capt sgt lt col gen gov sen rep hon st mt ft messrs mme mlle fig figs sec secs ch chap vol vols no nos nr
    pp p pg ed eds cf vs approx ca incl excl esp est dept viz al tab eq ref refs art arts max min avg tel ext op resp ibid add illus trans
    sr sra srta sres dra drs dña don pág págs pag núm num cap caps ej aprox av avda gral lic ing depto ud uds ex exmo profa
    env éd tél boul bd ste janv févr avr juil
    hr fr bzw vgl evtl ggf inkl zzgl bspw sog geb gest abs str abb bd hrsg mio mrd std tel allg bes
    стр рис табл гл ст ул им проф акад доц руб коп тыс млн млрд см ср напр ок св пп кв обл пер""".split()
)
# Abbreviations that may end a sentence.
MAY = frozenset(
    """etc usw inc ltd co corp bros jr jan feb mar apr jun jul aug sept sep oct nov dec lb oz ft yd hrs mins
    др пр гг вв a.m p.m u.s u.k e.u d.c s.a т.д т.п н.э""".split()
)
# German months, which follow an ordinal number.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "„": "“”", "“": "”"}
CLOSE = frozenset(")）]】」』》»”“\"")
BRACKET = re.compile(r"[()（）\[\]【】「」『』《》«»„“”\"]")
EMOJI = "\u203c\u2049\u2190-\u21ff\u2300-\u27bf\u2b00-\u2bff\ufe0f\u200d\U0001f000-\U0001faff"
MARKS = re.compile(r"[.!?…。！？｡]+(?:[\"”’»」』）】》)\]“]+|[ \xa0\u202f]»)*")
END_MARK = re.compile(r"[.!?…。！？｡][\"”’»」』）】》)\]“ \xa0\u202f]*$")
TOKEN = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*$|\d+$")
LIST_ITEM = re.compile(r"[ \t　]*(?:\(?\d{1,3}[.)、）]|[-*•‣·–]|\(?[a-zA-Z][)])[ \t　]+|[ \t　]*\d{1,3}、")
LABEL = re.compile(r"[ \t　]*[^\W\d_][^\n:：.!?。！？]{0,24}?[ \xa0]?[:：](?=\s|[^\x00-\x7f]|$)")
CJK = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
MARKED = re.compile(r"[.!?][\"”’»)]*(?:\s|$)|[。！？…]")
DENSE_BLANK = re.compile("(?<=[฀-๿຀-ໟက-႟ក-៿])[ \xa0　\t]+(?=[฀-๿຀-ໟက-႟ក-៿])")
WORDY = re.compile(r"[^\W_]")
BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029\x0b\x0c\x85]")
PARTICLES = frozenset("とってはがをのにもで、，,；;：:—–-")


BLANK, DOTS = "blank", "dots"
DENSE_TWO = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]{2}")
#: Without a fitted model blanks between letters of scripts without marks are cut.
UNFITTED = {BLANK: 4.0, DOTS: 0.5}


class Contexts:
    """Emissions and transitions of places without a mark that tells.

    `left` and `right` hold log likelihood ratios of the letters before and behind a
    boundary, `other` those of letters not in them (by side and number of letters).
    `chain` gives, for each kind of place, the log odds of a boundary after a place
    that is one and after one that isn't; a kind without an entry is even.
    """

    def __init__(self, left: dict[str, float], right: dict[str, float], other: dict[str, float] | None = None, chain: dict[str, tuple[float, float]] | None = None):
        self.left, self.right, self.other, self.chain = left, right, other or {}, chain or {}

    def score(self, before: str, after: str) -> float:
        """Positive when `before` tends to end and `after` to start sentences; fewer than two letters of these scripts say nothing."""
        a = b = 0.0
        if DENSE_TWO.match(before[-2:]):
            a = next((self.left[before[-n:]] for n in (3, 2) if before[-n:] in self.left), self.other.get("l", 0.0))
        if DENSE_TWO.match(after):
            b = next((self.right[after[:n]] for n in (3, 2) if after[:n] in self.right), self.other.get("r", 0.0))
        return a + b


def pairs(text: str, blocks: list[int]) -> list[tuple[int, int]]:
    """(open, close) places of quotations and brackets that open and close in one block of lines."""
    out, stack, at = [], [], 0
    for m in BRACKET.finditer(text):
        i, c = m.start(), m.group()
        k = bisect_left(blocks, i + 1)
        if k != at:
            stack, at = [], k
        match = next((j for j in range(len(stack) - 1, -1, -1) if c in OPEN.get(stack[j][1], stack[j][1])), None)
        if match is not None and (c != '"' or stack[match][1] == '"'):
            out.append((stack[match][0], i))
            del stack[match:]
        elif c in OPEN or c == '"':
            stack.append((i, c))
    return sorted(out)


def line_breaks(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Line breaks that end a sentence as (end of the line, start of the next), and where each block of lines begins.

    A single break inside a paragraph is a mere wrap if the next word would have made
    the line about as long as such lines are, for most of the paragraph's open line
    ends, and if the paragraph has marks at all.
    """
    spans, at = [], 0
    for m in BREAK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    if len(spans) == 1:
        return [], [0]
    lines = [text[a:b].rstrip() for a, b in spans]
    inner = sorted(len(x) for x, y in zip(lines, lines[1:], strict=False) if x and y)
    width = inner[len(inner) // 2] if inner else 0  # the middle one: single lines may be longer
    ends, blocks, i = [], [0], 0

    def starts_item(x: str) -> bool:
        return LIST_ITEM.match(x) is not None or LABEL.match(x) is not None

    while i < len(spans):
        if not lines[i].strip("\ufeff \t　\xa0"):
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and lines[j + 1].strip("\ufeff \t　\xa0"):
            j += 1
        # Lines i..j form a paragraph.
        if spans[i][0] > blocks[-1]:
            blocks.append(spans[i][0])
        free = total = 0
        for k in range(i, j):
            if END_MARK.search(lines[k]) or LIST_ITEM.match(lines[k + 1]):
                continue
            total += 1
            free += _full(lines[k], lines[k + 1], width)
        wrapped = total > 0 and free >= 0.7 * total and width >= 40 and MARKED.search(text, spans[i][0], spans[j][1]) is not None
        for k in range(i, j):
            nxt = lines[k + 1]
            item = LIST_ITEM.match(nxt) is not None or (LABEL.match(nxt) is not None and (END_MARK.search(lines[k]) is not None or not wrapped))
            if item or not wrapped or not _full(lines[k], nxt, width):
                if wrapped and not item and END_MARK.search(lines[k]):
                    continue  # the mark decides
                ends.append((spans[k][1], spans[k + 1][0]))
                blocks.append(spans[k + 1][0])
        if j + 1 < len(spans):
            ends.append((spans[j][1], spans[j + 1][0]))
            blocks.append(spans[j + 1][0])
        i = j + 1
    return ends, blocks


def _full(line: str, nxt: str, width: int) -> bool:
    """Whether the next line's first word wouldn't have fitted behind `line`."""
    if CJK.match(nxt.lstrip()[:1] or "a"):
        return len(line) + 2 > 0.88 * width
    word = nxt.split(None, 1)[0] if nxt.strip() else ""
    return len(line) + 1 + len(word) > 0.88 * width


def mark_score(text: str, m: re.Match, closed: dict[int, int], fresh) -> float:
    """Log odds that a sentence ends behind a cluster of marks and closing signs, outside of brackets."""
    start, end = m.span()
    marks = m.group().rstrip("\"”’»」』）】》)]“ \xa0\u202f")
    closers = m.group()[len(marks):]
    rest = text[end : end + 40]
    gap = len(rest) - len(rest.lstrip())
    nxt = rest[gap : gap + 1]
    if not nxt:
        return 10.0
    wrap = "\n" in rest[:gap] or "\r" in rest[:gap]
    upper = nxt.isupper() or nxt.istitle()
    dense = bool(CJK.match(nxt)) or bool(CJK.search(text[max(0, start - 2) : start]))
    if closers.strip():
        o = closed.get(end - 1)
        if o is None:
            return 4.0 if upper and gap else (6.0 if marks[0] in "。！？｡" else -2.0)
        opener = text[o]
        if opener == "《":
            return -8.0
        if nxt in ",;:，；、：—–-)]）】」』”»":
            return -8.0
        whole = fresh(o)
        if opener in "(（[【":
            if whole:
                return 8.0 if not nxt.islower() else 3.0
            return -6.0 if nxt.islower() or dense else 1.0
        if dense:
            if nxt in OPEN or nxt == '"':
                return 6.0
            return -5.0 if whole or nxt in PARTICLES else 5.0
        if nxt.islower():
            return -6.0
        return 5.0
    last = marks[-1]
    if "。" in marks or "！" in marks or "？" in marks or "｡" in marks:
        return 10.0 if nxt not in "、，,；;" else -6.0
    if "…" in marks or marks.startswith(".."):
        if dense:
            return 0.0  # the contexts decide
        return 4.0 if gap and (upper or nxt in OPEN or nxt in "¿¡\"") else -4.0
    if last in "!?":
        if not gap:
            return 4.0 if upper or CJK.match(nxt) or nxt in "¿¡“„«「" else -6.0
        if nxt in ",;:—–":
            return -6.0
        return 8.0 if not nxt.islower() else 3.0
    token = TOKEN.search(text[max(0, start - 24) : start])
    w = token.group() if token else ""
    low = w.lower()
    if not gap:
        two = rest[1:2]
        if len(w) > 1 and upper and (two.islower() or two in " '’" or two == "") and "." not in w and low not in NEVER and not re.search(r"[/@\\]\S*$", text[max(0, start - 40) : start]):
            return 4.0
        if w and nxt in "¿¡“„«「" and low not in NEVER:
            return 4.0
        return 6.0 if CJK.match(nxt) and not w.isdigit() and len(w) != 1 else -10.0
    starts = upper or nxt in OPEN or nxt in "¿¡\"" or CJK.match(nxt) is not None
    if w.isdigit():
        word = re.match(r"[^\W\d_]+", rest[gap:])
        if word and word.group().lower() in MONTHS:
            return -6.0
        return 6.0 if not nxt.islower() else 2.0
    if not w:
        return 4.0 if starts else -1.0
    if len(w) == 1 and w.isalpha():
        before = text[max(0, start - 5) : start - 1].strip().lower()
        if low in "дп" and before.endswith("т."):
            return 4.0 if starts else -6.0
        if low == "г" and re.search(r"\d\s*$", text[max(0, start - 4) : start - 1]):
            return 3.0 if starts else -6.0
        return -8.0
    if low in MAY:
        return 4.0 if starts and not nxt.isdigit() else -6.0
    if low == "no" and not nxt.isdigit():
        return 9.0 if starts else 1.0
    if low in NEVER or "." in w:
        return -8.0
    if nxt.islower():
        return 3.0
    return 9.0 if not wrap or starts else 8.0


def candidates(text: str, contexts: Contexts | None = None, kinds: dict[int, str] | None = None) -> list[tuple[int, float]]:
    """(place behind the last character, log odds) of every possible boundary, in order.

    `kinds` takes the kind of those places whose mark doesn't tell.
    """
    ends, blocks = line_breaks(text)
    shut = pairs(text, blocks)
    closed = {b: a for a, b in shut}
    inner: list[tuple[int, int]] = []  # outermost pairs
    for a, b in shut:
        if not inner or a > inner[-1][1]:
            inner.append((a, b))
    opens = [a for a, _ in inner]
    line_ends = [a for a, _ in ends]

    def inside(i: int) -> bool:
        k = bisect_left(opens, i) - 1
        return k >= 0 and inner[k][1] > i

    def fresh(o: int) -> bool:
        """Whether a bracket opens at the beginning of a sentence."""
        head = text[max(0, o - 80) : o].rstrip(" \t\xa0\u202f　\ufeff")
        if not head or head[-1] in "\n\r\u2028\u2029":
            k = bisect_left(blocks, o + 1) - 1
            if not head or k < 0 or not text[blocks[k] : o].strip("\ufeff \t　\xa0"):
                return True
            head = head.rstrip()
        k = max(0, bisect_left(blocks, o + 1) - 1)
        label = LABEL.match(text[blocks[k] : o])
        item = LIST_ITEM.match(text[blocks[k] : o])
        if (label and not text[blocks[k] + label.end() : o].strip() and blocks[k] + label.end() > o - 3 and is_turn(text[blocks[k] : o])) or (item and not text[blocks[k] + item.end() : o].strip()):
            return True
        return END_MARK.search(head) is not None

    found: dict[int, float] = {}
    for m in MARKS.finditer(text):
        end = m.end()
        body = m.group().rstrip("\"”’»」』）】》)]“ \xa0\u202f")
        # Leave closing signs that open something, or close nothing, out of the cluster.
        while end > m.start() + len(body) and text[end - 1] in CLOSE and (end - 1) not in closed and text[end - 1] in "“\"":
            end -= 1
        m2 = m if end == m.end() else MARKS.match(text, m.start(), end)
        if inside(m2.end()) or (inside(m2.start()) and m2.end() == m2.start() + len(body)):
            continue
        k = max(0, bisect_left(blocks, m2.start() + 1) - 1)
        item = LIST_ITEM.match(text, blocks[k])
        if item and m2.start() < item.end():
            continue
        s = mark_score(text, m2, closed, fresh)
        place = m2.end()
        if s == 0.0:
            s = UNFITTED[DOTS] if contexts is None else contexts.score(letters_before(text, m2.start()), letters_after(text, m2.end()))
            if kinds is not None:
                kinds[place] = DOTS
        tail = re.compile(f"[ \xa0]?[{EMOJI}]+(?=\\s|$)").match(text, place)
        found[tail.end() if tail and s > 0 else place] = s
    for m in DENSE_BLANK.finditer(text):
        if not inside(m.start()):
            found[m.start()] = UNFITTED[BLANK] if contexts is None else contexts.score(text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 3])
            if kinds is not None:
                kinds[m.start()] = BLANK
    for a in line_ends:
        found[a] = 20.0
    return sorted(found.items())


TURNS = re.compile(
    r"\s*(?:user|human|assistant|system|question|answer|q|a|bot|prompter|frage|antwort|nutzer|benutzer|assistent|question |réponse|utilisateur|pregunta|respuesta|usuario|asistente"
    r"|pergunta|resposta|usuário|assistente|вопрос|ответ|пользователь|ассистент|คำถาม|คำตอบ|ผู้ใช้|ผู้ช่วย|问|答|用户|助手|系统|質問|回答|ユーザー|アシスタント)[ \xa0]?[:：]\s*$",
    re.I,
)


def is_turn(head: str) -> bool:
    return TURNS.match(head) is not None


def letters_before(text: str, i: int) -> str:
    return re.sub(r"\W+", "", text[max(0, i - 8) : i])[-3:]


def letters_after(text: str, i: int) -> str:
    return re.sub(r"\W+", "", text[i : i + 8])[:3]


def decode(text: str, marks: list[tuple[int, float]], kinds: dict[int, str] | None = None, chain: dict[str, tuple[float, float]] | None = None) -> list[int]:
    """Viterbi decoding of the tags boundary and inside over the candidates: the chosen places.

    A boundary may only follow another if a letter or digit lies between them; line
    ends (which are certain) are exempt.  Places of a kind in `chain` add its log odds
    after a boundary or after an inside place.
    """
    n = len(marks)
    if not n:
        return []
    kinds, chain = kinds or {}, chain or {}
    # A state is (whether something wordy has come since the last boundary, whether the last candidate is a boundary).
    best = {(0, 1): 0.0}
    trail: list[dict[tuple[int, int], tuple[tuple[int, int], bool]]] = []
    at = 0
    for place, score in marks:
        wordy = WORDY.search(text, at, place) is not None
        at = place
        step_odds = chain.get(kinds.get(place, ""), (0.0, 0.0))
        new: dict[tuple[int, int], float] = {}
        step: dict[tuple[int, int], tuple[tuple[int, int], bool]] = {}
        for s, value in best.items():
            seen = 1 if s[0] or wordy else 0
            options = [((seen, 0), value, False)]
            if seen or score >= 20:
                options.append(((0, 1), value + score + (step_odds[0] if s[1] else step_odds[1]), True))
            for t, v, cut in options:
                if t not in new or v > new[t]:
                    new[t] = v
                    step[t] = (s, cut)
        best = new
        trail.append(step)
    s = max(best, key=lambda k: (best[k], -k[1]))
    out = []
    for k in range(n - 1, -1, -1):
        s, cut = trail[k][s]
        if cut:
            out.append(marks[k][0])
    return out[::-1]


def split_sentences(text: str | None, contexts: Contexts | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text in code points; none for null and blank texts."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    kinds: dict[int, str] = {}
    places = candidates(text, contexts, kinds)
    for cut in [*decode(text, places, kinds, contexts.chain if contexts is not None else None), len(text)]:
        a, b = at, cut
        while a < b and (text[a].isspace() or text[a] == "\ufeff"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] == "\ufeff"):
            b -= 1
        at = cut
        if a == b:
            continue
        if out and not WORDY.search(text, a, b) and not BREAK.search(text, out[-1][1], a):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


# Proven boundaries for counting: marks of their own, and empty lines.
PROOF = re.compile(r"[。！？｡!?]+|\n[ \t\r　]*\n|\r\n[ \t　]*\r\n")
SIDES = ("l", "r")
#: Places a context must hold of all proven boundaries to be kept, so at most 1/`KEPT` of each side and length are.
KEPT = 2e-5
#: Ends that the distribution inside stands for where proven ones are few.
PRIOR = 50


def is_dense(a: np.ndarray) -> np.ndarray:
    return ((a >= 0x0E00) & (a <= 0x0EFF)) | ((a >= 0x1000) & (a <= 0x109F)) | ((a >= 0x1780) & (a <= 0x17FF)) | ((a >= 0x3040) & (a <= 0x30FF)) | ((a >= 0x3400) & (a <= 0x9FFF))


def count_contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, ends, inside) of the groups of two and three letters before (odd keys) and behind places in scripts without blanks.

    The text is stripped of its punctuation: what lies between two letters only tells
    whether the place is proven, open (blanks and other signs) or inside.  Open places
    are left out.
    """
    flat = "\x00".join("\x00".join(PROOF.split(t)) for t in texts if t) + "\x00"
    a = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    cut = a == 0
    letter = is_dense(a)
    other = ~letter & ~cut & (a > 0x7F) & np.fromiter(map(str.isalnum, flat), bool, len(flat)) | (~letter & (a < 0x80) & np.isin(a, _ASCII_WORD))
    keep = np.flatnonzero(letter | other | cut)
    code, is_cut, ok = a[keep], cut[keep], letter[keep]
    near = np.diff(keep, append=len(a)) == 1  # nothing between this one and the next
    keys, ends, inside = [], [], []
    for n in (2, 3):
        if len(code) <= n + 1:
            break
        gram = np.zeros(len(code) - n + 1, dtype=np.int64)
        good = np.ones(len(gram), dtype=bool)
        for k in range(n):
            gram = (gram << 16) | (code[k : len(code) - n + 1 + k] & 0xFFFF)
            good &= ok[k : len(code) - n + 1 + k]
            if k:
                good &= near[k - 1 : len(code) - n + k]
        first, last = np.arange(len(gram)), np.arange(n - 1, len(code))
        after, before = np.minimum(last + 1, len(code) - 1), np.maximum(first - 1, 0)
        for side, end, within in (
            (1, is_cut[after], near[last] & ok[after]),
            (0, is_cut[before] | (first == 0), near[before] & ok[before] & (first > 0)),
        ):
            for flags, out, zero in ((good & end, ends, inside), (good & ~end & within, inside, ends)):
                k, c = np.unique(gram[flags] * 8 + (n - 2) * 2 + side, return_counts=True)
                keys.append(k)
                out.append(c)
                zero.append(np.zeros(len(c), dtype=np.int64))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(keys), np.concatenate(ends), np.concatenate(inside)


_ASCII_WORD = np.array([i for i in range(128) if chr(i).isalnum()])


def open_scores(texts: list[str], contexts: Contexts) -> list[tuple[str, int, int, int]]:
    """(kind, score before, score, n): how often places whose mark doesn't tell follow each other with these rounded scores; 999 without one before."""
    out: dict[tuple[str, int, int], int] = {}
    for t in texts:
        if not t:
            continue
        kinds: dict[int, str] = {}
        before = 999
        for place, score in open_places(t, contexts, kinds):
            s = max(-80, min(80, round(2 * score)))
            key = (kinds[place], before, s)
            out[key] = out.get(key, 0) + 1
            before = s
    return [(*k, n) for k, n in out.items()]


ELLIPSIS = re.compile(r"(?<=[぀-ヿ㐀-鿿])(?:…+|\.{2,})(?=[぀-ヿ㐀-鿿])")


def open_places(text: str, contexts: Contexts, kinds: dict[int, str]) -> list[tuple[int, float]]:
    """The places whose mark doesn't tell, in order, outside of what `candidates` looks at besides."""
    found = []
    for m in DENSE_BLANK.finditer(text):
        found.append((m.start(), contexts.score(text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 3])))
        kinds[m.start()] = BLANK
    for m in ELLIPSIS.finditer(text):
        found.append((m.end(), contexts.score(letters_before(text, m.start()), letters_after(text, m.end()))))
        kinds[m.end()] = DOTS
    return sorted(found)


def fit_chain(rows: list[tuple[str, int, int, int]], rounds: int = 50) -> dict[str, tuple[float, float]]:
    """Log odds of a boundary after a boundary and after an inside place, of each kind, by expectation maximisation over `open_scores`.

    Scores are log likelihood ratios, so a place's posterior follows from them and the
    transition; the expected transitions give the next ones.
    """
    out = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(0.0 if b == 999 else b / 2, b != 999, s / 2, n) for k, b, s, n in rows if k == kind]
        prev, has, cur, n = (np.array(x, dtype=float) for x in zip(*own, strict=True))
        p, after_b, after_i = 0.5, 0.5, 0.5
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        odds = lambda x: np.log(x / (1 - x))
        for _ in range(rounds):
            before = np.where(has > 0, sig(odds(p) + prev), 1.0)  # a text begins with a sentence
            b, i = sig(odds(after_b) + cur), sig(odds(after_i) + cur)
            now = before * b + (1 - before) * i
            total = n.sum() + 2
            p = float(np.clip(((n * now).sum() + 1) / total, 1e-4, 1 - 1e-4))
            after_b = float(np.clip(((n * before * b).sum() + 1) / ((n * before).sum() + 2), 1e-4, 1 - 1e-4))
            after_i = float(np.clip(((n * (1 - before) * i).sum() + p) / ((n * (1 - before)).sum() + 1), 1e-4, 1 - 1e-4))
        out[kind] = (float(odds(after_b)), float(odds(after_i)))
    return out


def ratio(ends: int, all_ends: int, inside: int, all_inside: int) -> float:
    """Log likelihood ratio of letters at proven ends against inside; what is known of them inside counts for `PRIOR` ends, so few ends prove little."""
    p = (inside + 0.3) / (all_inside + 1)
    return float(np.log((ends + PRIOR * p) / (all_ends + PRIOR)) - np.log(p))


def fit_contexts(docs: DataFrame, text_col: str = "text", kept: float = KEPT) -> Contexts:
    """Contexts and transitions fitted on all texts of scripts without blanks.

    The tables that reach the driver hold at most 1/`kept` groups of letters a side and
    length, and one row per pair of rounded scores.
    """
    t = docs.where(F.col(text_col).rlike("[฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-鿿]")).select(F.col(text_col).alias("t"))

    def count(batches):
        for pdf in batches:
            k, e, i = count_contexts(pdf["t"].tolist())
            yield pd.DataFrame({"key": k, "ends": e, "inside": i})

    rows = cut_lineage(spread(t).mapInPandas(count, "key bigint, ends bigint, inside bigint").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside")))
    group = F.col("key") % 8
    sums = {r["g"]: (r["e"], r["i"]) for r in rows.groupBy(group.alias("g")).agg(F.sum("ends").alias("e"), F.sum("inside").alias("i")).collect()}
    least = F.lit(0)
    for g, (e, _) in sums.items():
        least = F.when(group == g, F.lit(max(1.0, kept * e))).otherwise(least)
    got = rows.where((F.col("ends") > 0) & (F.col("ends") >= least)).collect()
    tables: dict[str, dict[str, float]] = {"l": {}, "r": {}}
    rest = {g: list(v) for g, v in sums.items()}
    for r in got:
        g = r["key"] % 8
        e, i = sums[g]
        gram, n = r["key"] // 8, 2 + g // 2
        rest[g][0] -= r["ends"]
        rest[g][1] -= r["inside"]
        tables["l" if g % 2 else "r"]["".join(chr(gram >> 16 * (n - 1 - j) & 0xFFFF) for j in range(n))] = ratio(r["ends"], e, r["inside"], i)
    other = {side: ratio(rest[g][0], sums[g][0], rest[g][1], sums[g][1]) for side, g in (("l", 1), ("r", 0)) if g in sums}
    model = Contexts(tables["l"], tables["r"], other)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for pdf in batches:
            yield pd.DataFrame(open_scores(pdf["t"].tolist(), shared.value), columns=["kind", "before", "score", "n"])

    seen = spread(t).mapInPandas(scores, "kind string, before int, score int, n bigint").groupBy("kind", "before", "score").agg(F.sum("n").alias("n")).collect()
    model.chain = fit_chain([tuple(r) for r in seen])
    return model


SENTENCES = T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: Contexts | None = None, with_text: bool = False) -> DataFrame:
    """(id_col, start_char, end_char[, sentence]): every sentence with its place, in code points, end exclusive.

    Null and blank texts have no sentences.  Equal rows give equal rows.  Without
    `contexts` they are fitted on the same documents.
    """
    ctx = contexts if contexts is not None else fit_contexts(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ctx)
    kind = docs.schema[id_col]
    fields = [T.StructField(id_col, kind.dataType), *SENTENCES.fields, *([T.StructField("sentence", T.StringType())] if with_text else [])]

    def run(batches):
        c = shared.value
        for pdf in batches:
            at, start, end, said = [], [], [], []
            for i, t in enumerate(pdf[text_col]):
                for a, b in split_sentences(t, c):
                    at.append(i)
                    start.append(a)
                    end.append(b)
                    if with_text:
                        said.append(t[a:b])
            out = pd.DataFrame({id_col: pdf[id_col].iloc[at].to_numpy(), "start_char": start, "end_char": end})
            if with_text:
                out["sentence"] = said
            yield out

    return spread(docs.select(id_col, text_col)).mapInPandas(run, T.StructType(fields))
