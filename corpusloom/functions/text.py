"""Text, role and task expressions.

All functions take and return `Column`s and stay inside whole-stage codegen,
except `nfc` and `nfc_segments`, Arrow UDFs, because Spark has no Unicode
normaliser; only texts with characters that composition may change reach them.  A
null input gives null unless stated otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.numeric import let
from corpusloom.schema import DIALOG_ROLE_ALIASES, ROLE_ALIASES, TASK_SYNONYMS

#: White space as Python's str.split and str.strip see it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
CJK = r"[一-鿿]"


def strip(c: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


@lru_cache(maxsize=1)
def unstable() -> str:
    """Class of the characters that canonical composition may change, alone or behind another one.

    Neighbouring runs are joined over gaps up to 64, so that a character is compared
    with few runs; a text of the gaps' characters takes the slower way unchanged.
    """
    points = {c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            points.add(int(parts[1], 16))
    points |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
    spans: list[list[int]] = []
    for c in sorted(points):
        if spans and (c - spans[-1][1] <= 64 or 0x10000 <= spans[-1][0] and c < 0x1F000):
            spans[-1][1] = c
        else:
            spans.append([c, c])
    one = lambda a, b: rf"\x{{{a:x}}}-\x{{{b:x}}}"
    widest = max(zip(spans, spans[1:], strict=False), key=lambda p: p[1][0] - p[0][1] if p[1][0] < 0x10000 else 0)
    # What most texts consist of is ruled out first: the letters before the first run and those of the widest gap.
    return f"[{one(spans[0][0], spans[-1][1])}&&[^{one(widest[0][1] + 1, widest[1][0] - 1)}]&&[{''.join(one(a, b) for a, b in spans)}]]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda a: a if a is None else [x if x is None else unicodedata.normalize("NFC", x) for x in a])


def nfc(c: Column) -> Column:
    """Canonical composition."""
    raw = (F.octet_length(c) > F.length(c)) & c.rlike(unstable())
    return F.when(raw, _nfc(F.when(raw, c))).otherwise(c)


def nfc_segments(segments: Column) -> Column:
    """Segments with composed contents; a UDF can't work inside a lambda, so the contents go through it as one array."""
    said = F.transform(segments, lambda s: s["content"])
    done = _nfc_each(F.when(F.exists(said, lambda x: F.coalesce(x.rlike(unstable()), F.lit(False))), said))
    return F.when(done.isNull(), segments).otherwise(F.zip_with(segments, done, lambda s, x: s.withField("content", x)))


def normalize_text(c: Column, compose: bool = True) -> Column:
    """NFC, LF line ends, stripped.  `compose=False` is for texts composed before, as inside lambdas."""
    return strip(unify_newlines(nfc(c) if compose else c))


def visible(c: Column) -> Column:
    """True when something can be seen: neither white space nor control or format characters.  Null is not visible."""
    return F.coalesce(c.rlike(r"[^\t-\r\x1c-\x20\x85\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def normalize_role(c: Column, dialog: bool = False) -> Column:
    """Canonical role name; unknown names come back trimmed and in lower case; null counts as ''."""
    aliases = ROLE_ALIASES | (DIALOG_ROLE_ALIASES if dialog else {})
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return let(F.lower(strip(F.coalesce(c, F.lit("")))), lambda k: F.coalesce(F.try_element_at(names, k), k))


def default_train(role: Column) -> Column:
    return role.isin("assistant", "text")


def normalize_task(task: Column, segments: Column, rejected: Column) -> Column:
    """lm, sft or preference: by name, else by the shape of the record."""
    key = F.lower(strip(F.coalesce(task, F.lit(""))))
    out = F.when(key.isin(*TASK_SYNONYMS["lm"]), "lm")
    for name in ("sft", "preference"):
        out = out.when(key.isin(*TASK_SYNONYMS[name]), name)
    return (
        out.when(F.coalesce(F.size(rejected), F.lit(0)) > 0, "preference")
        .when(F.coalesce(F.exists(segments, lambda s: s["role"] != "text"), F.lit(False)), "sft")
        .otherwise("lm")
    )


def name_key(c: Column) -> Column:
    """Names are equal if their letters and digits are, in lower case.  Null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]", "")


# Small letters whose case folding is another letter or several.
FOLDED = {"ß": "ss", "ς": "σ", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold_case(c: Column) -> Column:
    """Case folding: ß and SS, or the two small sigmas, agree."""

    def body(t: Column) -> Column:
        folded = reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), FOLDED.items(), t)
        return F.when(t.rlike(f"[{''.join(FOLDED)}]"), folded).otherwise(t)

    return let(F.lower(F.upper(c)), body)


def strip_special_tokens(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("<bos>"), F.lit("")), F.lit("<eos>"), F.lit("")))


def ascii_letter_ratio(c: Column) -> Column:
    """ASCII letters over all letters; null when there is no letter."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit("[A-Za-z]")) / letters)


def is_english(c: Column, min_ratio: float, min_letters: int = 8, when_short: bool = True) -> Column:
    """Share of ASCII letters at least `min_ratio`; texts under `min_letters` letters count as `when_short`."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters < min_letters, F.lit(when_short)).otherwise(F.regexp_count(c, F.lit("[A-Za-z]")) / letters >= min_ratio)


def matches_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of some literal phrases."""
    return reduce(lambda a, p: a | F.contains(c, F.lit(p)), phrases[1:], F.contains(c, F.lit(phrases[0])))


def json_value(c: Column) -> Column:
    """VARIANT of a text that is one JSON value, else null.

    Spark's own parser ignores what follows the first value; here a second item of a
    list around it must still be read.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"end"]')))
    ok = (F.try_variant_get(whole, "$[1]", "string") == "end") & F.try_variant_get(whole, "$[2]", "variant").isNull()
    return F.when(ok, F.try_variant_get(whole, "$[0]", "variant"))


def coerce_text(c: Column, depth: int = 4) -> Column:
    """Text of a VARIANT: null → '', strings as they are, lists line by line without nulls, objects as JSON.

    Lists inside lists are flattened `depth` times; deeper ones come as JSON.
    """
    kind = F.schema_of_variant(c)
    items = F.filter(F.try_variant_get(c, "$", "array<variant>"), lambda x: ~F.is_variant_null(x))
    lines = F.transform(items, (lambda x: coerce_text(x, depth - 1)) if depth > 1 else (lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    return F.when(c.isNull() | F.is_variant_null(c), "").when(kind.startswith("ARRAY"), F.array_join(lines, "\n")).when(kind.startswith("OBJECT"), F.to_json(c)).otherwise(F.try_variant_get(c, "$", "string"))


def interactive_prompt(c: Column) -> Column:
    """A bare prompt as a chat prompt; text that has role labels already is kept."""
    return F.when(c.rlike(r"(?im)^(user|assistant|system|用户|助手|系统)\s*[:：]"), c).otherwise(F.concat(F.lit("User: "), strip(c), F.lit("\nAssistant: ")))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def cjk_ratio(c: Column) -> Column:
    """CJK characters over CJK characters and ASCII letters and digits; 0 for texts without any."""
    n = cjk_count(c) + F.regexp_count(c, F.lit("[A-Za-z0-9]"))
    return F.when(n > 0, cjk_count(c) / n).otherwise(F.lit(0.0))


def is_chinese(c: Column, min_cjk: int, min_ratio: float, max_ascii_letters: int, reject_links: bool = True) -> Column:
    ok = (F.regexp_count(c, F.lit("[A-Za-z]")) <= max_ascii_letters) & (cjk_count(c) >= min_cjk) & (cjk_ratio(c) >= min_ratio)
    return ok & ~c.rlike(r"(?i)https?://|www\.|@") if reject_links else ok


def tighten_cjk(c: Column) -> Column:
    """Drop blanks between CJK characters, digits and punctuation, but not between two digits."""
    return F.regexp_replace(c, r"(?<=[一-鿿\p{P}]) (?=[一-鿿\p{Nd}\p{P}])|(?<=\p{Nd}) (?=[一-鿿\p{P}])", "")


def clean_lines(c: Column, compose: bool = True) -> Column:
    """Keep lines, right-trim each, at most one empty line in a row, no empty line at either end."""
    t = unify_newlines(nfc(c) if compose else c)
    t = F.regexp_replace(t, r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    t = F.regexp_replace(t, r"[\t \x1f\p{Zs}]+(?=\n|$)", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_flat(c: Column, compose: bool = True) -> Column:
    """One line: every run of white space becomes one blank."""
    return collapse_space(nfc(c) if compose else c)


def clean_each_line(c: Column, compose: bool = True) -> Column:
    """Collapse white space inside each line and drop blank lines."""
    t = unify_newlines(nfc(c) if compose else c)
    t = F.regexp_replace(t, r"[\t \x1f\p{Zs}]+", " ")
    return strip(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def clean_chinese(c: Column, compose: bool = True) -> Column:
    """Flat text with the escaped comma restored and CJK spacing tightened."""
    return tighten_cjk(collapse_space(F.replace(nfc(c) if compose else c, F.lit("_comma_"), F.lit("，"))))


def shorten(c: Column, n: int) -> Column:
    """At most `n` characters, the last three of a cut text being dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("...")))


def split_list(c: Column, sep: str = ",") -> Column:
    """Comma list → trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def int_sizes(c: Column) -> Column:
    """Comma list → sorted distinct whole numbers above 1."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(split_list(c), lambda x: x.try_cast("int")), lambda x: x > 1)))


def literal_list(c: Column) -> Column:
    """Parts of a list literal written with single quotes."""
    return F.regexp_extract_all(c, F.lit(r"'([^']*)'"), F.lit(1))
