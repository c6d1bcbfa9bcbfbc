"""Defective prompt and response pairs.

Prompt and response tokens are aligned — shingle containment first, then the
longest common subsequence — to flag copies; sentences of the response are aligned
with refusal templates, sequences of slots that must occur in order.  Truncation is
told by open brackets, quotes, fences and rows, and by how often the last words end a
sentence elsewhere, counted over all records; the language by the rank-order profiles.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_role
from corpusloom.llm.language import CLOSE, Profiles, is_sentence, segment_languages
from corpusloom.llm.sentences import split_sentences
from corpusloom.operators.skew import cut_lineage, join_unique

SHINGLE = 5
#: Share of an answer's shingles, or of its words, that a copy has in common with its question.
CONTAINED, WORDS = 0.8, 0.6
#: Share of the tokens of both that the common subsequence must hold; a token of scripts without blanks is one character.
SPACED_SHARE, DENSE_SHARE = 0.75, 0.85
TOKENS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_]+(?:['’][^\W_]+)*")
DENSE = re.compile("[぀-ヿ㐀-鿿฀-๿]")
HAN_RUN = re.compile("[㐀-鿿]{2,}|[゠-ヿ]{2,}")
THAI_RUN = re.compile("[฀-๿]{6,}")

# What stands in for an answer, compared without brackets and case.
PLACEHOLDERS = frozenset(
    """none null nil nan na n/a n.a todo tbd tba undefined unknown empty blank missing placeholder pad bos eos unk endoftext mask
    no answer|no response|no reply|no output|response missing|answer missing|missing response|missing answer|not available|not applicable
    your answer here|answer here|insert answer here|to be done|to be added|sin respuesta|pas de réponse|keine antwort|sem resposta|нет ответа
    无|没有回答|暂无|未回答|回答なし|なし|未回答|ไม่มีคำตอบ""".replace("\n", "|").replace("    ", "").split("|")
) | frozenset("none null nil nan na n/a n.a todo tbd tba undefined empty blank missing placeholder pad bos eos unk endoftext mask".split())
MARKUP_TOKENS = re.compile(r"<\|?/?(?:pad|bos|eos|unk|s|mask|endoftext|startoftext|im_start|im_end)\|?>|\[(?:pad|bos|eos|unk|mask|cls|sep)\]", re.I)

# How a request to repeat reads in the languages covered.
REPEAT = re.compile(r"(?i)repeat|verbatim|word for word|echo|copy|wiederhol|abschreib|répét|recopi|repit|repet|copi[ae]|повтор|перепиш|重复|复述|照抄|繰り返|復唱|ซ้ำ|ทวน|คัดลอก")

# Names of the languages in all of them.
LANGUAGE_NAMES = {
    "en": "english inglés inglese inglês anglais englisch английск 英语 英文 英語 อังกฤษ",
    "zh": "chinese chino chinês chinois chinesisch китайск 中文 汉语 漢語 中国語 จีน mandarin",
    "ja": "japanese japonés japonês japonais japanisch японск 日语 日文 日本語 ญี่ปุ่น",
    "de": "german alemán alemão allemand deutsch немецк 德语 德文 ドイツ語 เยอรมัน",
    "fr": "french francés francês français französisch французск 法语 法文 フランス語 ฝรั่งเศส",
    "es": "spanish español espanhol espagnol spanisch испанск 西班牙语 西班牙文 スペイン語 สเปน castellano",
    "pt": "portuguese portugués português portugais portugiesisch португальск 葡萄牙语 葡萄牙文 ポルトガル語 โปรตุเกส",
    "ru": "russian ruso russo russe russisch русск 俄语 俄文 ロシア語 รัสเซีย",
    "th": "thai tailandés tailandês thaï thaïlandais thailändisch тайск 泰语 泰文 タイ語 ไทย",
}

# Refusal templates.  A slot is a list of phrases, one of which must stand there; a phrase ending in * may go on within
# its word.  A template is a sequence of slots with, behind each, how many characters may lie before the next one.
SLOTS = {
    # English
    "self": "i|i'm|i've|i'll|we|we're|it's|it is|as an ai|as a language model|as an assistant|as a large language model|this is something i'm|as an ai model|as an ai language model",
    "cannot": "can't|cant|cannot|can not|could not|couldn't|won't|will not|won't be able|wouldn't be able|unable|not able|not allowed|not permitted|not in a position|not possible|impossible"
    "|must decline|have to decline|have to refuse|must refuse|decline|refuse|don't feel comfortable|not comfortable|told not|been instructed not|against my|would rather not|prefer not",
    "but": "enough|too much|too highly|too strongly|recommend|stress",
    "act": "help*|assist*|answer*|respond*|reply*|do what you ask|do that|do this|fulfil*|comply*|complete*|provide*|share*|give*|offer*|discuss*|comment*|talk*|speak*|write*|produce*|create*|generate*|go into|engage*|support*"
    "|handle*|continue*|disclose*|reveal*|advise*|accommodate*|satisfy*|carry out|perform*|cover*",
    "model": "as an ai|as a language model|as a large language model|as an ai language model|as an ai model|as an assistant",
    "i": "i|i'm|i've",
    "not": "not|isn't|don't|can't|won't|unable|cannot",
    "sorry": "sorry|regret|apologise|apologize|unfortunately|regrettably",
    "bound": "can't|cannot|unable|not able|won't|must|have to|not allowed|refuse|decline",
    "off": "not a topic|not a subject|not something|no topic|no subject",
    "i can": "i can|i could|i am able|i'm able|i may|i will|we can",
    "rules": "guideline*|rule*|policy|policies|instruction*|principles|programming|terms",
    "prevent": "prevent*|forbid*|prohibit*|do not allow|don't allow|does not allow|doesn't allow|do not let|don't let|do not permit|don't permit|keep me from|stop me from|bar me",
    # German
    "de can": "kann|darf|möchte|werde",
    "de not": "nicht|kein|keine|keinen|keiner",
    "de act": "helfen|beantworten|geben|antworten|weiterhelfen|bereitstellen|erteilen|unterstützen|liefern|schreiben|besprechen|dienen|sagen|äußern|anbieten|erfüllen",
    "de must": "muss|möchte",
    "de refuse": "ablehnen|verweigern",
    "de model": "als ki|als sprachmodell",
    "de unable": "bin nicht in der lage",
    # French
    "fr self": "je|nous",
    "fr ne": "ne",
    "fr can": "peux|puis|suis|pourrai|veux|souhaite|saurais|pouvons",
    "fr act": "aider|répondre|donner|fournir|partager|discuter|écrire|traiter|parler|satisfaire|autorisé|mesure|faire|commenter",
    "fr must": "dois|devons",
    "fr refuse": "refuser|décliner",
    "fr model": "en tant que modèle|en tant que ia|en tant que assistant|en tant qu'assistant|en tant qu'ia",
    # Spanish
    "es no": "no",
    "es can": "puedo|podré|podemos|debo|quiero|soy capaz|me es posible|estoy autorizado|estoy autorizada|estoy en condiciones",
    "es act": "ayudar*|responder*|contestar*|dar*|proporcionar*|compartir*|hablar*|ofrecer*|escribir*|comentar*|hacer*|facilitar*|atender*",
    "es must": "debo|tengo que",
    "es refuse": "rechazar|negarme|rehusar",
    "es model": "como modelo de lenguaje|como un modelo de lenguaje",
    # Portuguese
    "pt no": "não|nao",
    "pt can": "posso|poderei|podemos|devo|quero|consigo|me é possível|estou autorizado|estou autorizada|sou capaz",
    "pt act": "ajud*|respond*|dar*|fornec*|compartilh*|partilh*|fal*|oferec*|escrev*|coment*|faz*|atend*|discut*",
    "pt must": "devo|tenho que|preciso",
    "pt refuse": "recusar|declinar",
    "pt model": "como modelo de linguagem|como um modelo de linguagem",
    # Russian
    "ru cannot": "не могу|не можем|не смогу|не вправе|не имею права|не в состоянии|не буду|не готов*",
    "ru act": "помо*|ответ*|отвеч*|предостав*|дать|дава*|подел*|обсужд*|написа*|выполн*|сдела*|говор*|комментир*",
    "ru must": "вынужден*|должен|должна",
    "ru refuse": "отказ*",
    "ru model": "как языковая модель",
    "ru not": "не",
}
DENSE_SLOTS = {
    # Chinese
    "zh self": "我|本助手",
    "zh cannot": "无法|不能|不便|不可以|没办法|难以|不会|不得不拒绝|必须拒绝|拒绝|没法|帮不了|帮不上",
    "zh act": "回答|提供|讨论|帮|协助|答复|透露|分享|满足|处理|谈|写|完成|给出|评论",
    "zh sorry": "抱歉|对不起|很遗憾|遗憾",
    "zh model": "作为语言模型|作为一个语言模型|作为一名语言模型|作为人工智能|作为一个人工智能|作为一名人工智能|作为助手|作为一个助手|作为一名助手|语言模型",
    "zh unable": "帮不了您|帮不了你",
    # Japanese
    "ja act": "お答え|回答|お手伝い|提供|お応え|対応|協力|お教え|共有|支援|ご案内|お話し|お受け|お助け",
    "ja cannot": "できません|できない|できかねます|いたしかねます|しかねます|お断り",
    "ja refuse": "お断りし|お断りいた|お断りさせ",
    "ja model": "言語モデルとして|aiとして|アシスタントとして",
    # Thai
    "th cannot": "ไม่สามารถ|ไม่อาจ|ไม่ขอ|ขอปฏิเสธ",
    "th act": "ช่วย|ตอบ|ให้|แบ่งปัน|พูด|เขียน|ดำเนินการ|แสดงความ|ทำ|บอก",
    "th able": "ตอบ|ช่วย|ให้",
    "th not": "ไม่ได้",
    "th refuse": "ขอปฏิเสธ",
}
TEMPLATES = [
    [("self", 40), ("cannot", 30), ("act", 0)],
    [("model", 30), ("i", 30), ("not", 0)],
    [("sorry", 40), ("bound", 40), ("act", 0)],
    [("off", 20), ("i can", 20), ("act", 0)],
    [("rules", 30), ("prevent", 0)],
    [("de can", 40), ("de not", 40), ("de act", 0)],
    [("de must", 30), ("de refuse", 0)],
    [("de model", 30), ("de not", 0)],
    [("de unable", 0)],
    [("fr self", 12), ("fr ne", 6), ("fr can", 40), ("fr act", 0)],
    [("fr must", 20), ("fr refuse", 0)],
    [("fr model", 60), ("fr ne", 0)],
    [("es no", 6), ("es can", 40), ("es act", 0)],
    [("es must", 12), ("es refuse", 0)],
    [("es model", 60), ("es no", 0)],
    [("pt no", 6), ("pt can", 40), ("pt act", 0)],
    [("pt must", 12), ("pt refuse", 0)],
    [("pt model", 60), ("pt no", 0)],
    [("ru cannot", 40), ("ru act", 0)],
    [("ru must", 20), ("ru refuse", 0)],
    [("ru model", 60), ("ru not", 0)],
    [("zh self", 8), ("zh cannot", 12), ("zh act", 0)],
    [("zh sorry", 16), ("zh cannot", 0)],
    [("zh model", 12), ("zh cannot", 0)],
    [("zh unable", 0)],
    [("ja act", 8), ("ja cannot", 0)],
    [("ja refuse", 0)],
    [("ja model", 30), ("ja cannot", 0)],
    [("th cannot", 20), ("th act", 0)],
    [("th able", 24), ("th not", 0)],
    [("th refuse", 0)],
]
#: A slot that breaks a chain: none of its phrases may follow `cannot` within so many characters.
GUARD = ("cannot", "but", 30)


def _slot_pattern(phrases: str, dense: bool) -> re.Pattern:
    one = [re.escape(x[:-1]) + r"\w*" if x.endswith("*") else re.escape(x) + ("" if dense else r"\b") for x in sorted(phrases.split("|"), key=len, reverse=True)]
    return re.compile(("" if dense else r"\b") + "(?:" + "|".join(one) + ")")


SLOT_PATTERNS = {k: _slot_pattern(v, False) for k, v in SLOTS.items()} | {k: _slot_pattern(v, True) for k, v in DENSE_SLOTS.items()}
#: The rarest slot of each template; a text without any of them follows none.
TRIGGERS = ("cannot", "not", "bound", "off", "prevent", "de not", "de refuse", "de unable", "fr ne", "fr refuse", "es no", "es refuse", "pt no", "pt refuse", "ru not", "ru refuse", "zh cannot", "zh unable", "ja cannot", "ja refuse", "th cannot", "th not", "th refuse")
_PHRASES = [x for k in TRIGGERS for x in (SLOTS | DENSE_SLOTS)[k].split("|")]
#: The longest word of each of their phrases, those that may go on within a word, and those of scripts without blanks.
TRIGGER_WORDS = frozenset(max(x.split(), key=len) for k in TRIGGERS if k in SLOTS for x in SLOTS[k].split("|") if not x.endswith("*"))
TRIGGER_PARTS = tuple(x.rstrip("*") for x in _PHRASES if x.endswith("*")) + tuple(x for k in TRIGGERS if k in DENSE_SLOTS for x in DENSE_SLOTS[k].split("|"))


def aligned(text: str) -> list[tuple[int, int]]:
    """Spans of a lower-case text that align with a refusal template: all its slots in order, each near enough to the one before.

    For every prefix of a template the latest end of a chain that matches it is kept,
    as no other end leaves more room for the next slot.
    """
    found: dict[str, list[tuple[int, int]]] = {}

    def places(slot: str) -> list[tuple[int, int]]:
        if slot not in found:
            found[slot] = [m.span() for m in SLOT_PATTERNS[slot].finditer(text)]
        return found[slot]

    out = []
    for template in TEMPLATES:
        chains = [(a, b) for a, b in places(template[0][0])]
        for (slot, gap), (nxt, _) in zip(template, template[1:], strict=False):
            if not chains:
                break
            if slot == GUARD[0]:
                chains = [(a, b) for a, b in chains if not any(b <= x <= b + GUARD[2] for x, _ in places(GUARD[1]))]
            longer, k, held = [], 0, None
            for x, y in places(nxt):
                while k < len(chains) and chains[k][1] <= x:
                    held = chains[k]
                    k += 1
                if held is not None and x - held[1] <= gap:
                    longer.append((held[0], y))
            chains = longer
        out += chains
    return out


# What goes along with a refusal without answering: excuses, reasons and pointers elsewhere.
SUPPORT = re.compile(
    r"(?i)\b(?:sorry|apolog\w+|regret\w*|unfortunately|thank\w*|polic(?:y|ies)|guidelines?|harmful|confidential|not (?:allowed|permitted)|(?:outside|beyond)(?: of)? (?:my|what i|the scope)"
    r"|specialists?|experts?|professionals?|lawyers?|doctors?|consult|contact|someone|somebody|elsewhere|another question|something else|anything else|other (?:questions?|topics?|requests?)|happy to help|for understanding|your understanding|feel free|please"
    r"|leider|entschuldig\w+|tut mir leid|bitte|richtlinien|fach(?:mann|frau|leute|person)|experten?|verständnis|désolée?|malheureusement|expert\w*|spécialistes?|veuillez|merci"
    r"|lo siento|lamento|lamentablemente|desculp\w+|infelizmente|políticas?|especialistas?|por favor|gracias|obrigad[oa]|comprensión|compreensão)\b"
    r"|извин|к сожалению|простите|специалист|эксперт|пожалуйста|抱歉|对不起|對不起|遗憾|政策|专家|专业人士|(?:别的|其他)问题|换一?个(?:问题|話題|话题)|語言模型|语言模型|申し訳|すみません|恐れ入り|専門家|ご了承|残念|別の質問|言語モデル|ขออภัย|ในฐานะ|คำถามอื่น|ขอโทษ|เสียใจ|นโยบาย|ผู้เชี่ยวชาญ|กรุณา|โปรด"
)
QUOTED = re.compile(r"[“„«「『\"][^“”„«»「」『』\"\n]{0,200}[”“»」』\"]")

EMOTICON = re.compile(r"[\s←-⇿⌀-➿⬀-⯿️‍\U0001f000-\U0001faff]+$|\s+[:;=8][-o']?[()DPp/|\\]\s*$")
ASIDE_END = re.compile(r"\s*(?:[\[(（【「『《][^\[\]()（）「」『』《》【】\n.!?。！？]{1,60}[\])）】」』》])\s*$")
TERMINAL = re.compile(r"[.!?。！？…｡][\"”’»」』）)\]】*_~` 　 ]*$")
#: Lengths of the contexts of scripts without blanks.
RUNS = (8, 5, 4, 3, 2)
# Abbreviations that something must follow.
CALLS_ON = re.compile(r"(?i)(?:^|[\s(,;])(?:e\.\s?g|i\.\s?e|z\.\s?b|d\.\s?h|u\.\s?a|p\.\s?ej|por ej|p\.\s?ex|par ex|c\.-à-d|т\.\s?е|напр|vs|cf|viz|bzw)\.$")
MEASURE = re.compile(r"\W*\d[\d.,\s]*[^\W\d_]{1,3}")
LETTER = re.compile(r"[^\W\d_]")
BARE_MARKER = re.compile(r"\s*(?:\d{1,3}[.)、]|[-*•])\s*$")
OPENERS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "“": "”"}


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def visible_text(text: str) -> str:
    """Letters, digits and symbols of a text, without marks, white space, control and special tokens."""
    return re.sub(r"[\W_]+", "", MARKUP_TOKENS.sub("", text))


#: Letters and digits of the longest placeholder.
LONGEST = max(sum(map(str.isalnum, x)) for x in PLACEHOLDERS)


def is_empty(text: str) -> bool:
    """Nothing visible, marks only, or a placeholder."""
    if "<" not in text and "[" not in text and sum(1 for _ in islice(filter(str.isalnum, text), LONGEST + 1)) > LONGEST:
        return False  # more letters than any placeholder has
    core = visible_text(text)
    if not core:
        return not re.search("[←-⇿⌀-➿⬀-⯿\U0001f000-\U0001faff]", text)
    low = " ".join(re.sub(r"[\s\[\](){}<>|\"'“”‘’«»「」*_.:!-]+", " ", text.lower()).split())
    return low in PLACEHOLDERS or low.replace(" ", "") in ("n/a", "na")


def common_length(a: list[str], b: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence and the first place of `a` in it, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & where.get(y, 0)
        row = ((row + m) | (row - m)) & full
    taken = ~row & full
    return taken.bit_count(), (taken & -taken).bit_length() - 1 if taken else 0


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def is_copy(prompt: str, answer: str, words: list[str] | None = None) -> bool:
    """Whether the answer gives back the question, once or several times, and nothing else, though not asked to repeat.

    Only an answer that shares `WORDS` of its words is looked at, as every word of a
    contained shingle is shared.  The longest common subsequence of the tokens then
    decides, or the five-word shingles (`CONTAINED` of the question's) where words were
    put in.
    """
    a = tokens(answer) if words is None else words
    p = tokens(prompt)
    if not p or not a or len(a) < WORDS * min(len(p), SHINGLE):
        return False
    known = set(p)
    if sum(map(known.__contains__, a)) < WORDS * len(a):
        return False  # nor can enough shingles be contained
    held = len(shingles(a) & shingles(p))
    # Where the answer starts in the prompt: the head before it may only be a reference or label.
    start = next((i for i in range(len(p)) if any(p[i : i + 2] == a[k : k + 2] for k in range(3))), 0)
    unit = p[start:]
    times = max(1, round(len(a) / len(unit)))
    if len(a) > 1.3 * len(unit) * times + 3 * times:
        return False
    share = DENSE_SHARE if DENSE.match(p[-1]) else SPACED_SHARE
    n, _ = common_length(unit * times, a)
    # The answer may add a word or two to each copy.
    if n < share * len(a) and (n < len(a) - 3 * times or held < CONTAINED * len(shingles(unit))):
        return False
    if n < share * len(unit) * times:
        return False
    if not start:
        return True
    places = [m.start() for m in TOKENS.finditer(prompt.lower())]
    before = prompt[: places[start]].rstrip(" \t\n¿¡\"'“„«「『([*_>")
    if REPEAT.search(before):
        return False
    return bool(before) and before[-1] in ":：.。,，)）]】-–—>»\"”" or DENSE.match(p[start]) is not None and before[-1:] in "て：，）"


def without_quotes(text: str) -> str:
    return QUOTED.sub(" ", text.replace("’", "'"))


def topics(text: str) -> set[str]:
    """What a text is about: words of six letters or more, pairs of Han or Katakana letters and runs of six Thai letters."""
    low = text.lower()
    grams = {run[i : i + 2] for run in HAN_RUN.findall(low) for i in range(len(run) - 1)} | {run[i : i + 6] for run in THAI_RUN.findall(low) for i in range(len(run) - 5)}
    return {w for w in tokens(low) if len(w) >= 6} | grams


def may_refuse(low: str, words: list[str] | None = None) -> bool:
    """Whether a lower-case text holds a trigger of any template, as a word or, in scripts without blanks, anywhere."""
    return not TRIGGER_WORDS.isdisjoint(tokens(low) if words is None else words) or any(x in low for x in TRIGGER_PARTS)


def refusing(plain: str, spans: list[tuple[int, int]]) -> list[bool]:
    """Which sentences align with a refusal template; Thai ones may be cut at blanks, so there a template may reach over several."""
    low = plain.lower() if len(plain.lower()) == len(plain) else plain
    out = [may_refuse(low[a:b]) and bool(aligned(low[a:b])) for a, b in spans]
    if any("฀" <= c <= "๿" for c in plain):
        for x, y in aligned(low):
            out = [o or (a < y and x < b) for o, (a, b) in zip(out, spans, strict=True)]
    return out


def is_refusal(answer: str, prompt: str = "", words: list[str] | None = None) -> bool:
    """Whether a sentence aligns with a refusal template and the others answer nothing.

    Every sentence is aligned.  Another one answers if it takes up something the prompt is about
    and neither excuses, explains the refusal nor points elsewhere; so do code and rows of a table,
    and whatever fills more words ahead of the refusal than the refusal has, as it can't explain it yet.
    """
    if not may_refuse(answer.replace("’", "'").lower(), words if words is None or "’" not in answer else None):
        return False
    plain = without_quotes(answer)
    spans = split_sentences(plain)
    hit = refusing(plain, spans)
    if not any(hit):
        return False
    if "```" in plain or "|--" in plain:
        return False
    asked = topics(prompt)
    first = hit.index(True)
    said = [plain[a:b] for a, b in spans]
    other = [(i, x) for i, x in enumerate(said) if not hit[i] and not SUPPORT.search(x)]
    if any(topics(x) & asked for _, x in other):
        return False
    ahead = sum(len(tokens(x)) for i, x in other if i < first)
    return ahead <= max(4, sum(len(tokens(x)) for i, x in enumerate(said) if hit[i]))


FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
ROW = re.compile(r"^[ \t]*\|.*$", re.M)


def prose(text: str) -> str:
    """A text without code fences and, if it holds a table, without its rows."""
    text = FENCE.sub("\n", text)
    return ROW.sub("", text) if "|--" in text or "| --" in text else text


def ending_keys(sentence: str) -> list[str]:
    """Keys of a sentence's end, from the longest context to the shortest."""
    words = [re.sub(r"\d+", "#", x) for x in tokens(sentence)]
    if not words:
        return []
    if DENSE.match(words[-1]):
        tail = re.sub(r"[\W\d_]+", "", sentence.lower())
        return [tail[-n:] for n in RUNS if len(tail) >= n] or [tail]
    return [(words[-2] if len(words) > 1 else "^") + " " + words[-1], words[-1]]


# The same in the JVM: what ends a sentence there, and the last one or two words of a piece.
J_CUT = r"[。！？｡…]+|[.!?][.!?\"”’»」』）)\]]*(?=\s|$)|\s+(?=[฀-๿])"
J_WORD = r"[\p{L}\p{N}#]+(?:['’][\p{L}\p{N}#]+)*"
J_DENSE_END = r"[぀-ヿ㐀-鿿฀-๿][^\p{L}\p{N}#]*$"
J_THAI_END = r"[฀-๿]$"


def ending_counts(records: DataFrame) -> DataFrame:
    """(key, ends): how often each context of `ending_keys` ends a sentence, in all segments of all records.

    Only ends count that a mark or, in Thai, a next sentence proves: a line may be
    wrapped, and the last words of a text without a mark may be broken off themselves.  Keys are 64-bit hashes,
    counted by a partial aggregation in the JVM.
    """
    t = records.select(F.explode("segments.content").alias("t")).where("t is not null").select(F.split(F.lower("t"), J_CUT).alias("p"))
    # The last piece is what no mark follows; where one does, it is empty.
    s = t.select(F.explode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("s")).select(F.regexp_replace(F.substring("s", -200, 200), r"\d+", "#").alias("s"))
    dense = F.col("s").rlike(J_DENSE_END)
    flat = F.regexp_replace("s", r"[^\p{L}]+", "")
    s = s.select(dense.alias("dense"), F.when(dense, flat).alias("flat"), F.when(~dense, F.regexp_extract_all("s", F.lit(J_WORD), F.lit(0))).alias("w"))
    last = F.try_element_at("w", F.lit(-1))
    runs = F.array(*[F.when(F.length("flat") >= n, F.substring("flat", -n, n)) for n in RUNS])
    words = F.array(F.concat(F.coalesce(F.try_element_at("w", F.lit(-2)), F.lit("^")), F.lit(" "), last), last)
    k = s.select(F.explode(F.when(F.col("dense"), runs).otherwise(words)).alias("k"))
    return k.where("k is not null").groupBy(F.xxhash64("k").alias("key")).agg(F.count(F.lit(1)).alias("ends"))


#: A context tells if so many texts or sentences end in it.
SEEN = 5
#: It can end a text if it ends this many sentences for every text that it ends without a mark.
SHARE = 1.0
#: An answer without a final mark that so many different questions get is a stock phrase and breaks off nowhere.
STOCK = 3


class Endings:
    """Endings in memory, for fixtures and for use without Spark: {context: ends}."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts

    def can_end(self, keys: list[str]) -> bool:
        """Whether one of the contexts, the longest or a shorter one, ended sentences often enough to tell."""
        return any(self.counts.get(k, 0) >= SEEN for k in keys)


def last_sentence(t: str) -> str:
    """The last sentence-like part of a text, found from its end."""
    at = len(t)
    for m in re.finditer(r"[\n\r]|[.!?…]\s|[。！？｡…]|(?<=[฀-๿])\s(?=[฀-๿])", t[::-1]):
        if m.start() > 0 and t[len(t) - m.start() :].strip():
            at = m.start()
            break
    return t[len(t) - at :].strip() or t


def breaks_off(answer: str) -> bool | list[str]:
    """Whether an answer breaks off; where only its last words can tell, their `ending_keys`."""
    t = answer.rstrip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    head, _, last_line = t.rpartition("\n")
    if head.strip() and BARE_MARKER.fullmatch(last_line):
        return True
    last_line = last_line.strip()
    if last_line.startswith("|"):
        return not last_line.endswith("|") or t.count("\n|---") + t.count("\n| ---") > 0 and last_line.count("|") != t[: t.find("\n|-")].rsplit("\n", 1)[-1].count("|")
    # Closing symbols and short foreign asides behind the text don't matter.
    while True:
        u = ASIDE_END.sub("", EMOTICON.sub("", t)).rstrip()
        if u == t or not u:
            break
        t = u
    if CALLS_ON.search(t):
        return True
    if not t or TERMINAL.search(t.rstrip(",，、;；:： ")) and not t.endswith(("etc.,", "...,")):
        return False
    if t[-1] in "(（[【「『《«“„,，、;；:：-–—/&+=" or t.endswith((" \"", "\n\"")):
        return True
    if TERMINAL.search(t):
        return False
    last = last_sentence(t)
    for o, c in OPENERS.items():
        if last.count(o) > last.count(c):
            return True
    if last.count('"') % 2:
        return True
    last = last.rstrip("\"”’»」』）)]】*_~` ")
    if TERMINAL.search(last) or not LETTER.search(last) or MEASURE.fullmatch(last):
        return False  # a number is complete, with or without a unit
    return ending_keys(last)


def asks_for(prompt: str, lang: str) -> bool:
    """Whether a text names a language, in any of the languages covered."""
    low = prompt.lower()
    return any(name in low for name in LANGUAGE_NAMES.get(lang, "").split())


def judge(prompts: list[str], answers: list[str], systems: list[str], profiles: Profiles, endings: Endings | None = None) -> list:
    """Defect of each pair, or None; the first that applies of empty, copy, refusal, language and truncated.

    Without `endings`, a pair whose last words must tell whether it breaks off has their keys, a list.
    """
    out: list = [None] * len(prompts)
    left = []
    for i, (p, a) in enumerate(zip(prompts, answers, strict=True)):
        if is_empty(a):
            out[i] = "empty"
            continue
        words = tokens(a)
        if is_copy(p, a, words):
            out[i] = "copy"
        elif is_refusal(a, p, words):
            out[i] = "refusal"
        else:
            left.append(i)
    for i in other_language(prompts, answers, systems, left, profiles):
        out[i] = "language"
    for i in left:
        if out[i] is None:
            t = breaks_off(answers[i])
            if isinstance(t, list) and endings is not None:
                t = not endings.can_end(t)
            out[i] = "truncated" if t is True else t or None
    return out


def other_language(prompts: list[str], answers: list[str], systems: list[str], left: list[int], profiles: Profiles) -> list[int]:
    """Places, of those in `left`, whose answer is wholly in another language than the question, though not asked for.

    Answers and questions are compared as wholes; only those of different languages are looked at by their sentences.
    """
    # Code and tables say nothing of an answer's language.
    plain = [prose(answers[i]) for i in left]
    lang_a, _, letters, margin, near_a = profiles.classify(plain)
    _, _, _, _, near_q = profiles.classify([prompts[i] for i in left])
    apart = [k for k in range(len(left)) if lang_a[k] >= 0 and letters[k] >= 6 and margin[k] >= CLOSE and not near_q[k] >> lang_a[k] & 1 and is_sentence(plain[k])]
    said = segment_languages(profiles, [plain[k] for k in apart])
    asked = segment_languages(profiles, [prompts[left[k]] for k in apart])
    out = []
    for n, k in enumerate(apart):
        a, q = ({x[2] for x in st[n]} for st in (said, asked))
        i = left[k]
        if a == {int(lang_a[k])} and q and not a & q and not any(near_a[k] >> x & 1 for x in q) and not asks_for(prompts[i] + " " + systems[i], profiles.langs[lang_a[k]]):
            out.append(i)
    return out


def trained_pairs(records: DataFrame) -> DataFrame:
    """(id, seg_idx, prompt, answer, system): assistant segments, trained or with null `train`, directly after a user's.

    Null contents count as ''.  `system` is the record's system text.  Null ids are left out.
    """
    s = F.transform("segments", lambda x: F.struct(normalize_role(x["role"]).alias("role"), F.coalesce(x["content"], F.lit("")).alias("content"), x["train"].alias("train")))
    r = records.where(F.col("id").isNotNull()).select("id", s.alias("s")).where("size(s) > 1")
    idx = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: (F.get(F.col("s"), i)["role"] == "assistant") & (F.get(F.col("s"), i - 1)["role"] == "user") & F.coalesce(F.get(F.col("s"), i)["train"], F.lit(True)))
    system = F.array_join(F.transform(F.filter("s", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n")
    return r.select("id", "s", system.alias("system"), F.explode(idx).alias("seg_idx")).select(
        "id", "seg_idx", F.get(F.col("s"), F.col("seg_idx") - 1)["content"].alias("prompt"), F.get(F.col("s"), F.col("seg_idx"))["content"].alias("answer"), "system"
    )


def fit_endings(records: DataFrame) -> Endings:
    """The endings of a fixture in memory.  `defective_pairs` never collects them."""
    words: dict[str, None] = {}
    for r in records.select(F.explode("segments.content").alias("t")).where("t is not null").collect():
        flat = [re.sub(r"\d+", "#", x) for x in tokens(r["t"])]
        for i, w in enumerate(flat):
            words |= {w: None, "^ " + w: None, (flat[i - 1] if i else "^") + " " + w: None}
        dense = re.sub(r"[\W\d_]+", "", r["t"].lower())
        for n in RUNS:
            words |= {dense[i : i + n]: None for i in range(len(dense) - n + 1)}
    named = records.sparkSession.createDataFrame([(k,) for k in words], "word string").select("word", F.xxhash64("word").alias("key"))
    return Endings({r["word"]: r["ends"] for r in named.join(ending_counts(records), "key").collect()})


def judged_pairs(pairs: DataFrame, profiles: Profiles) -> DataFrame:
    """(h, defect, keys, said): the defect of each distinct pair, or the keys of the last words that must tell and a hash of the answer."""
    shared = pairs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for pdf in batches:
            d = judge(pdf["prompt"].tolist(), pdf["answer"].tolist(), pdf["system"].tolist(), shared.value)
            out = pdf[["h", "asked", "said"]].assign(defect=[x if isinstance(x, str) else None for x in d], keys=[x if isinstance(x, list) else None for x in d])
            yield out[out["defect"].notna() | out["keys"].notna()]

    return pairs.mapInPandas(run, "h binary, asked bigint, said bigint, defect string, keys array<string>")


def broken_off(open_pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The `h` of those pairs (h, asked, said, keys) whose last words don't end sentences elsewhere.

    Distinct keys are looked up in the counts over all records, and counted over the
    pairs themselves; the longest one seen often enough decides.  Answers that many
    questions get are no fragments.
    """
    o = open_pairs.withColumn("k", F.xxhash64("keys"))
    distinct = cut_lineage(o.groupBy("k").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n")))
    places = distinct.select("k", "n", F.posexplode("keys").alias("i", "word")).select("k", "i", "n", F.xxhash64("word").alias("key"))
    loose = places.groupBy("key").agg(F.sum("n").alias("texts"))
    table = cut_lineage(loose.join(ending_counts(records), "key", "left").na.fill(0, ["ends"]).where(F.col("ends") + F.col("texts") >= SEEN).select("key", (F.col("ends") >= SHARE * F.col("texts")).alias("ok")))
    seen = places.join(table, "key")  # one row per key on the right; on the left one per distinct ending
    told = seen.groupBy("k").agg(F.min_by("ok", "i").alias("ok"))
    bad = cut_lineage(distinct.select("k", "n").join(told, "k", "left").where(~F.coalesce("ok", F.lit(False))).select("k", "n", F.lit(True).alias("bad")))
    stock = cut_lineage(o.groupBy("said").agg(F.countDistinct("asked").alias("questions"), F.count(F.lit(1)).alias("n")).where(F.col("questions") >= STOCK).select("said", "n", F.lit(True).alias("stock")))
    total = o.count()
    found = join_unique(o.select("h", "said", "k"), bad, ["k"], "n", total).where("bad")
    return join_unique(found.select("h", "said"), stock, ["said"], "n", total).where("stock is null").select("h")


def defective_pairs(records: DataFrame, profiles: Profiles) -> DataFrame:
    """(id, seg_idx, defect) of the defective pairs, each once however often its record was delivered.

    Equal pairs are judged once, by the hash of their texts, and the defects joined
    back.  None of the tables reaches the driver or is broadcast beyond the hot keys
    of `join_unique`.
    """
    p = trained_pairs(records).withColumn("h", F.unhex(F.md5(F.to_json(F.struct("prompt", "answer", "system")))))
    once = p.groupBy("h").agg(F.first("prompt").alias("prompt"), F.first("answer").alias("answer"), F.first("system").alias("system"))
    once = once.select("*", F.xxhash64("prompt").alias("asked"), F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower("answer"), r"\d+", "0"), r"[^\p{L}\p{N}]+", "")).alias("said"))
    found = cut_lineage(judged_pairs(once, profiles))
    late = broken_off(found.where("keys is not null").select("h", "asked", "said", "keys"), records).select("h", F.lit("truncated").alias("defect"))
    defects = found.where("defect is not null").select("h", "defect").unionByName(late)
    ids = cut_lineage(p.select("id", "seg_idx", "h"))
    right = cut_lineage(defects.join(ids.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"))
    return join_unique(ids, right, ["h"], "n", ids.count()).where("defect is not null").select("id", "seg_idx", "defect").distinct()
