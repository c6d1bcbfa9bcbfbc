"""Validators: one column with the first failing reason, 'ok' if none fails.

Cheap predicates come first in the CASE; token bounds need a token column made
from the survivors only, so they are a second column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.numeric import let
from corpusloom.operators import dialog as D

# Phrases of prompts that ask for overlong answers.
BAD_PROMPT_PHRASES = (
    "generate a detailed and long answer",
    "write an article",
    "write a long",
    "produce a long",
    "long descriptive",
    "write a story",
    "write an essay",
)
# Prompts without content.
GENERIC_PROMPTS = (
    "hi", "hello", "hey", "hi.", "hello.", "how are you", "how are you?", "how are you today", "how are you today?",
    "what are you doing", "what are you doing?", "tell me about yourself", "tell me more about yourself",
)
# Assistant boilerplate.
BAD_ASSISTANT_PHRASES = (
    "as an ai language model",
    "as a language model",
    "i do not have emotions",
    "i don't have emotions",
    "i do not have personal opinions",
    "i don't have personal opinions",
    "i cannot provide a personal opinion",
    "i am not capable of having feelings",
)


@dataclass(frozen=True)
class Bounds:
    """Limits of a validator; characters are code points, 0 or None switches a limit off."""

    min_record_chars: int = 0
    max_record_chars: int = 6000
    max_prompt_chars: int = 0
    max_response_chars: int = 2400
    min_response_chars: int = 0
    min_record_tokens: int = 0
    max_record_tokens: int = 0
    max_prompt_tokens: int = 0
    min_response_tokens: int = 0
    max_response_tokens: int = 0
    min_english_ratio: float = 0.0
    min_cjk_ratio: float = 0.0
    min_cjk_chars: int = 0
    max_ascii_letters: int = 0


def visible_prompt(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: ~s["train"]), lambda s: F.concat(s["role"], F.lit(":"), D.flat_lower(s["content"]))), "\n")


def bad_prompt(segments: Column) -> Column:
    """A phrase asking for an overlong answer, or a last user text without content."""
    users = F.filter(segments, lambda s: (s["role"] == "user") & ~s["train"])
    last = F.coalesce(D.flat_lower(F.try_element_at(users, F.lit(-1))["content"]), F.lit(""))
    return let(visible_prompt(segments), lambda p: X.matches_any(p, BAD_PROMPT_PHRASES)) | let(last, lambda x: x.isin(*GENERIC_PROMPTS))


def bad_template(segments: Column) -> Column:
    said = F.lower(F.array_join(F.transform(F.filter(segments, lambda s: s["role"] == "assistant"), lambda s: s["content"]), "\n"))
    return let(said, lambda t: X.matches_any(t, BAD_ASSISTANT_PHRASES))


def ends_with_answer(segments: Column) -> Column:
    return F.coalesce(F.try_element_at(segments, F.lit(-1))["role"] == "assistant", F.lit(False))


def quality_reason(segments: Column, b: Bounds) -> Column:
    """bad_roles, no_user, bad_prompt, the character limits, non_english, else ok."""
    record, prompt, response = D.render(segments), D.render(segments, lambda s: ~s["train"]), D.render(segments, lambda s: s["train"])
    r = F.when(~ends_with_answer(segments), "bad_roles").when(~D.has_role(segments, "user"), "no_user").when(bad_prompt(segments), "bad_prompt")
    r = r.when(F.length(record) > b.max_record_chars, "too_long_record_chars")
    if b.max_prompt_chars:
        r = r.when(F.length(prompt) > b.max_prompt_chars, "too_long_prompt_chars")
    r = r.when(F.length(response) > b.max_response_chars, "too_long_response_chars")
    if b.min_english_ratio:
        r = r.when(~X.is_english(record, b.min_english_ratio), "non_english")
    return r.otherwise("ok")


def daily_reason(segments: Column, b: Bounds) -> Column:
    """bad_roles and the maximum characters of record and response, else ok."""
    r = F.when(~ends_with_answer(segments), "bad_roles")
    r = r.when(F.length(D.render(segments)) > b.max_record_chars, "too_long_record_chars")
    return r.when(F.length(D.render(segments, lambda s: s["train"])) > b.max_response_chars, "too_long_response_chars").otherwise("ok")


def chinese_base(segments: Column, b: Bounds, links: bool = True) -> Column:
    """bad_roles, non_chinese (with `links` addresses too) and the characters of the record, else null."""
    chinese = lambda c: X.is_chinese(c, b.min_cjk_chars, b.min_cjk_ratio, b.max_ascii_letters or 10**9, links)
    n = F.length(D.render(segments))
    r = F.when(~ends_with_answer(segments), "bad_roles").when(F.exists(segments, lambda s: ~chinese(s["content"])), "non_chinese")
    return r.when(n < b.min_record_chars, "too_short_record_chars").when(n > b.max_record_chars, "too_long_record_chars")


def chinese_reason(segments: Column, b: Bounds) -> Column:
    """`chinese_base` and the characters of the rendered response, else ok."""
    m = F.length(D.render(segments, lambda s: s["train"]))
    return F.coalesce(chinese_base(segments, b), F.when(m < b.min_response_chars, "too_short_response_chars").when(m > b.max_response_chars, "too_long_response_chars"), F.lit("ok"))


def logic_reason(segments: Column, b: Bounds, record_tokens: Column | None = None, prompt_tokens: Column | None = None, each_tokens: Column | None = None) -> Column:
    """`chinese_base` without addresses, token limits of record and prompt, then the limits of each trained segment, else ok.

    A segment's characters are its content's, its tokens (`each_tokens`, an array along
    the trained segments) those of its rendering; the first one to fail decides.
    """

    def one(s: Column, i: Column) -> Column:
        n = F.length(s["content"])
        r = F.when(n < b.min_response_chars, "too_short_response_chars").when(n > b.max_response_chars, "too_long_response_chars")
        if each_tokens is not None:
            r = r.when(F.get(each_tokens, i) < b.min_response_tokens, "too_short_response")
            r = r.when(F.get(each_tokens, i) > b.max_response_tokens, "too_long_response") if b.max_response_tokens else r
        return r

    bad = F.filter(F.transform(F.filter(segments, lambda s: s["train"]), one), lambda x: x.isNotNull())
    tokens = [] if record_tokens is None else [F.nullif(token_reason(record_tokens, prompt_tokens, None, b), F.lit("ok"))]
    return F.coalesce(chinese_base(segments, b, False), *tokens, F.get(bad, F.lit(0)), F.lit("ok"))


def token_reason(record: Column, prompt: Column, response: Column | None, b: Bounds) -> Column:
    """Token limits over counted columns, else ok; without `response` those of record and prompt."""
    r = F.when(record < b.min_record_tokens, "too_short_record")
    limits = [(b.max_record_tokens, record, False, "too_long_record"), (b.max_prompt_tokens, prompt, False, "too_long_prompt")]
    if response is not None:
        limits += [(b.min_response_tokens, response, True, "too_short_response"), (b.max_response_tokens, response, False, "too_long_response")]
    for limit, column, low, name in limits:
        if limit:
            r = r.when(column < limit if low else column > limit, name)
    return r.otherwise("ok")


def short_dialog_ok(segments: Column, min_turns: int = 2, chars: tuple[int, int] = (0, 6000), target_chars: tuple[int, int] = (1, 2400)) -> Column:
    """Enough turns, a user, and total, target and single answers within their characters."""
    total = F.length(D.render(segments))
    target = F.length(D.render(segments, lambda s: s["train"]))
    return (
        (D.turn_count(segments) >= min_turns) & D.has_role(segments, "user") & total.between(*chars) & target.between(*target_chars)
        & ~F.exists(segments, lambda s: (s["role"] == "assistant") & (F.length(s["content"]) > target_chars[1]))
    )


def chat_mix_ok(segments: Column, min_turns: int = 2, min_record_chars: int = 40, max_user_chars: int = 1600, min_assistant_chars: int = 20, max_assistant_chars: int = 2400, english_ratio: float = 0.9) -> Column:
    """Conjunction over trimmed segments: turns, both roles, characters, English and no boilerplate."""
    chars = lambda s: F.aggregate(F.transform(s, lambda x: F.length(x["content"])), F.lit(0), lambda a, n: a + n)
    assistant = F.filter(segments, lambda s: s["role"] == "assistant")
    text = F.array_join(F.transform(segments, lambda s: F.concat(s["role"], F.lit(": "), s["content"])), "\n")
    return (
        (D.turn_count(segments) >= min_turns) & D.has_role(segments, "user") & D.has_role(segments, "assistant") & (chars(segments) >= min_record_chars)
        & ~F.exists(segments, lambda s: (s["role"] == "user") & (F.length(s["content"]) > max_user_chars)) & (chars(assistant) >= min_assistant_chars)
        & ~F.exists(assistant, lambda s: F.length(s["content"]) > max_assistant_chars) & X.is_english(text, english_ratio, 20, False) & ~bad_template(segments)
    )


def message_ok(max_toxicity: float = 0.5) -> Column:
    """Row filter of a message table: English, not deleted, review not failed, not toxic, a speaker's role and some text.

    A null review passes; so does a toxicity that is null or no number.
    """
    toxicity = F.col("detoxify.toxicity").try_cast("double")
    return (
        (F.col("lang") == "en") & ~F.coalesce("deleted", F.lit(False)) & F.coalesce("review_result", F.lit(True)) & F.coalesce(toxicity <= max_toxicity, F.lit(True))
        & X.normalize_role(F.col("role")).isin("user", "assistant") & F.coalesce(X.strip(F.col("text")) != "", F.lit(False))
    )


def language_ok(language: Column) -> Column:
    """Language gate: absent, empty, en or english pass."""
    return language.isNull() | (language == "") | F.lower(language).isin("en", "english")
