"""Broken prompt and response pairs: empty, refusing, copying, truncated answers and answers in another language.

Answer and request are aligned as token sequences: containment of shingles of two tokens first, then the longest common
subsequence, computed bit-parallel, flags copies; sentences aligned with templates by shingles with gaps flag refusals, however long the
answer is; a last value that is the beginning of one of the request's is cut off. Sound answers get no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.languages import asked, lacks, language
from veinstone.operators.skew import join_hot
from veinstone.session import once, stored

#: What a refusal says, as tokens that may have up to GAP others between them.
REFUSALS = [
    "i can't help", "i cannot help", "i can not help", "i can't assist", "i cannot assist", "i can't provide", "i cannot provide", "i can't comply", "i cannot comply", "i cannot continue", "i can't continue", "i can't answer", "i cannot answer",
    "i am not able to", "i'm not able to", "i am unable to", "i'm unable to", "i won't be able to", "i will not be able to", "i must decline", "i have to decline", "i must refuse", "i have to refuse", "i refuse to", "i decline to",
    "i'd rather not", "i would rather not", "i'd prefer not to", "i would prefer not to", "i am not comfortable", "i'm not comfortable", "against my guidelines", "against my policy", "i am not allowed to", "i'm not allowed to",
    "kann ich nicht", "ich kann nicht helfen", "ich kann diese nicht", "darf ich nicht", "ich darf nicht", "muss ich ablehnen", "ich muss ablehnen", "lehne ich ab", "möchte ich nicht beantworten", "verstößt gegen meine richtlinien",
    "je ne peux pas", "je ne puis", "je dois refuser", "je refuse de", "je préfère ne pas", "il ne m'est pas permis", "je ne suis pas autorisé", "je ne suis pas en mesure", "contraire à mes consignes",
    "no puedo ayudar", "no puedo", "debo rechazar", "tengo que rechazar", "prefiero no responder", "no me está permitido", "no estoy autorizado", "va en contra de mis normas", "me niego a",
    "não posso ajudar", "não posso responder", "não posso", "não consigo ajudar", "tenho de recusar", "devo recusar", "prefiro não responder", "recuso me a", "non posso aiutare", "non posso", "devo rifiutare", "preferisco non rispondere",
    "ik kan niet helpen", "daar kan ik niet", "ik moet weigeren", "nie mogę pomóc", "muszę odmówić", "jag kan inte hjälpa", "я не могу", "не могу помочь", "вынужден отказать", "вынуждена отказать",
    "我无法", "我不能", "我拒绝", "无法协助", "无法继续", "违反了使用规范", "我不便", "拒绝回答", "お答えできません", "お答えすることはできません", "お手伝いできません", "お手伝いすることはできません", "お断りします", "対応できません", "応じられません", "도와드릴 수 없습니다", "답변할 수 없습니다",
]
#: Tokens that may stand between two of a template's.
GAP = 3
_DENSE = "㐀-鿿぀-ヿ"
_TOKEN = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+(?:['’][^\W_{_DENSE}]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_FENCE = re.compile(r"```[a-zA-Z]*")
_UNSEEN = re.compile("[​-‏⁠﻿­]")
_QUOTES = "\"“”„«»「」"
_ROLE = re.compile(r"^\s*(?:[>#*\"“„«「]+\s*)?(?:q|question|user|prompt|instruction|frage|pregunta|问题|用户|问)\s*[:：]\s*", re.I)
_END = re.compile(r"[.!?…。！？][\"'”’»)\]）」*_`]*$")
_COUNT = {32, 40, 56, 64, 96, 128}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


@lru_cache(maxsize=8192)
def _told(told: str) -> tuple[list[str], str | None, str | None]:
    """(tokens, language asked for, language written in) of an instruction; instructions recur."""
    return tokens(told), asked(told), language(told)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one machine-word operation per 64 tokens of a and token of b."""
    where: dict[str, int] = {}
    for n, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << n
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def contained(a: list[str], b: list[str], n: int = 2) -> float:
    """Share of a's shingles of n tokens that b has."""
    mine = [tuple(a[i : i + n]) for i in range(max(1, len(a) - n + 1))]
    theirs = {tuple(b[i : i + n]) for i in range(max(1, len(b) - n + 1))}
    return sum(s in theirs for s in mine) / len(mine)


def instruction(request: str) -> str:
    """The part of a user message that tells what to do: outside quotation, else the first or last paragraph, whichever is
    shorter (a passage is longer than its instruction)."""
    if ('"""' in request or "```" in request) and (m := re.search(r'"""(.*?)"""|```(.*?)```', request, re.S)):
        return (request[: m.start()] + "\n" + request[m.end() :]).strip()
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", request) if p.strip()]
    if not paragraphs:
        return ""
    first, last = paragraphs[0], paragraphs[-1]
    return first if len(tokens(first)) <= len(tokens(last)) else last


def is_empty(answer: str | None) -> bool:
    """Nothing to read: no letter, digit or symbol but fences, marks, white and unseen characters."""
    return answer is None or not re.search(r"[^\W_]", _UNSEEN.sub("", _FENCE.sub("", answer) if "```" in answer else answer))


def _aligned(template: list[str], sentence: list[str]) -> int | None:
    """Where the template's tokens begin in the sentence, in order and with at most GAP others between two of them."""
    for start in (i for i, t in enumerate(sentence) if t == template[0]):
        at = start
        for token in template[1:]:
            near = sentence[at + 1 : at + 2 + GAP]
            if token not in near:
                break
            at += 1 + near.index(token)
        else:
            return start
    return None


def _index() -> dict[str, list[list[str]]]:
    """Templates by their longest token, without which none of them aligns."""
    index: dict[str, list[list[str]]] = {}
    for template in map(tokens, REFUSALS):
        index.setdefault(max(template, key=len), []).append(template)
    return index


_TEMPLATES = _index()


def _declines(sentence: str, words: list[str]) -> bool:
    """Whether a sentence, outside quotation, aligns with a refusal template: shingles with gaps first, then the alignment."""
    present = set(words)
    for key in present & _TEMPLATES.keys():
        for template in _TEMPLATES[key]:
            if not present.issuperset(template):
                continue
            near = {(a, b) for n, a in enumerate(words) for b in words[n + 1 : n + 2 + GAP]} if len(template) > 1 else set()
            if all(pair in near for pair in zip(template, template[1:])) and common(template, words) == len(template):
                at = _aligned(template, words)
                if at is not None and not _quoted(sentence, [m.start() for m in _TOKEN.finditer(sentence.lower().replace("’", "'"))][at]):
                    return True
    return False


def _quoted(sentence: str, at: int) -> bool:
    """Whether a place lies after a quotation mark that opened before it and inside what that quotes."""
    return any(q in sentence[:at] for q in _QUOTES)


def is_refusal(answer: str, request: str = "", words: list[str] | None = None) -> bool:
    """A sentence of the answer, wherever it stands and however long the answer is, declines, and less than half of the answer
    is an answer all the same: sentences whose shingles are the request's."""
    words = tokens(answer) if words is None else words
    if _TEMPLATES.keys().isdisjoint(words):
        return False
    said = [(x, tokens(x)) for x in _SENTENCE.split(answer.strip()) if x and x.strip()]
    declined = [_declines(x, w) for x, w in said]
    if not any(declined):
        return False
    passage = tokens(request)
    pairs = set(zip(passage, passage[1:]))
    answering = sum(len(w) for (_, w), no in zip(said, declined) if not no and len(w) > 3 and 2 * sum(p in pairs for p in zip(w, w[1:])) >= len(w) - 1)
    return 2 * answering < len(words)


def is_copy(answer: str, request: str, told: str, words: list[str] | None = None) -> bool:
    """The answer aligns with the whole request, or with its instruction, and adds next to nothing."""
    given = [x.strip() for x in answer.split("\n") if x.strip()]
    lines = list(dict.fromkeys(given))
    if words is not None and len(lines) == len(given) and not _ROLE.match(answer):
        mine = words
    else:
        mine = tokens(_ROLE.sub("", "\n".join(lines)))
    if not mine:
        return False
    for n, least in enumerate((0.65, 0.8)):
        other = tokens(request) if n else _told(told)[0]
        if other and least * len(other) <= len(mine) <= 1.25 * len(other) + 1 and contained(mine, other) >= 0.5:
            shared = common(mine, other)
            if shared >= 0.84 * len(mine) and shared >= least * len(other):
                return True
    return False


def _cut_markup(text: str) -> bool:
    open_tags: list[str] = []
    if text.rfind("<") > text.rfind(">"):
        return True
    for closing, name, empty in re.findall(r"<(/?)([A-Za-z][\w.-]*)[^<>]*?(/?)>", text):
        if closing:
            if name in open_tags:
                while open_tags.pop() != name:
                    pass
        elif not empty:
            open_tags.append(name)
    return bool(open_tags) or text.count("```") % 2 == 1


_ITEM = re.compile(r"(?:[-*•–]|\d+[.)])\s+(.*)$")
_VALUE = re.compile(r"[\w@\[\]][^\s\"“”„«»<>|,;()]*")


def _values(request: str) -> set[str]:
    """The request's values: runs of characters with a digit, a dot, a slash or an at sign inside, as they stand and without dots at
    their end."""
    found = {v.rstrip(".:!?'’") for v in _VALUE.findall(request)}
    return {v for v in found if re.search(r"\d|[\w\]][./@:\\-]\w", v)}


def _begins(value: str, request: str) -> bool | None:
    """Whether a value is only the beginning of one of the request's; False if the request has it whole, None if not at all."""
    bare = value.rstrip(".:!?'’")
    if len(bare) < 2 or bare not in request:
        return None
    values = _values(request)
    if bare in values:
        return False
    return True if any(v.startswith(bare) for v in values) else None


def _cut_value(value: str, others: list[str], request: str) -> bool:
    """Whether a bare value breaks off: it only begins one of the request's values, or its form is not whole."""
    value = value.strip().rstrip(".,;") if not re.fullmatch(r"[\d.]+\.", value.strip()) else value.strip()
    if (begins := _begins(value, request)) is not None:
        return begins
    if re.fullmatch(r"[0-9a-f]{7,}", value) and re.search(r"\d", value):
        return len(value) not in _COUNT
    if re.fullmatch(r"\d{1,3}(\.\d{0,3}){0,3}\.?", value) and "." in value:
        return len([x for x in value.split(".") if x]) < 4
    if re.match(r"(?i)cve-", value):
        return not re.fullmatch(r"(?i)cve-\d{4}-\d{4,7}", value)
    if m := re.fullmatch(r"(?i)(?:(h[tx]{2}ps?)(:?/{0,2}))?(?:[\w.+-]+@)?([\w.\[\]-]*)(/\S*)?", value):
        scheme, host, path = m[1], m[3].replace("[.]", "."), m[4]
        if not scheme and "@" not in value and "." not in host:
            return False  # a name or a single word
        if scheme and m[2] != "://":
            return True
        last = host.rpartition(".")[2]
        if "." not in host or not last:
            return True
        ends = {h.rpartition(".")[2] for x in others if " " not in x and (h := re.sub(r"^\w+://|/.*$", "", x.rstrip(".,;").replace("[.]", "."))) and "." in h}
        if not path and last not in ends and any(e.startswith(last) for e in ends):
            return True
        sizes = {len(x.rpartition("/")[2]) for x in others if re.fullmatch(r"\S+://\S+/[0-9a-f]+", x)}
        return bool(scheme and path and sizes and len(path) - 1 < min(sizes) and re.fullmatch(r"/[0-9a-f]*", path))
    return False


def is_truncated(answer: str, request: str = "") -> bool:
    """The answer breaks off inside markup, a value or a sentence."""
    text = _UNSEEN.sub("", answer).strip()
    if "<" in text and (re.search(r"</?[A-Za-z][\w.-]*[^<>]*>", text) or re.search(r"<[A-Za-z/][\w-]*$", text)):
        return _cut_markup(text)
    if text.count("```") % 2:
        return True
    lines = [x.strip() for x in _FENCE.sub("", text).split("\n") if x.strip()]
    last = lines[-1]
    item = _ITEM.match(last)
    body = item[1] if item else last
    if " " not in body and not re.search(r"[㐀-鿿]", body):
        return _cut_value(body, [m[1] if (m := _ITEM.match(x)) else x for x in lines[:-1]], request)
    if item and len(tokens(body)) <= 3 and not _END.search(body):
        return False
    if not _END.search(last):
        return len(tokens(last)) > 2
    value = _VALUE.findall(last[-300:])
    return bool(value) and "." in value[-1].rstrip(".") and bool(re.search(r"\d\.?$", value[-1])) and last.endswith(value[-1]) and bool(_begins(value[-1], request))


def _four(prose: str) -> bool:
    """Whether there are four tokens."""
    return sum(1 for _ in islice(_TOKEN.finditer(prose), 4)) == 4


def in_other_language(answer: str, told: str) -> bool:
    """The answer's prose is in another language than asked for, or than the instruction's."""
    if re.search(r"</[A-Za-z]", answer):
        return False
    prose = "\n".join(x for x in answer.split("\n") if not re.match(r"\s*(?:[-*•–]|\d+[.)])\s", x) and " " in x.strip() or re.search(r"[㐀-鿿]", x))
    told_words, named, written = _told(told)
    if "\n" in prose and len(told_words) > 3 and tokens(prose[: prose.find("\n")])[: len(told_words)] == told_words:
        prose = prose[prose.find("\n") + 1 :]  # the question repeated before the answer
    prose = " ".join(x for x in prose.split() if "." not in x[:-1] and not re.fullmatch("[0-9a-f]{16,}", x))
    if not _four(prose):
        return False
    found, wanted = language(prose), named or written
    if found and wanted and found != wanted:
        return True
    return bool(wanted and not found and lacks(prose, wanted) or found and not wanted and lacks(told, found))


def defect(answer: str | None, request: str | None) -> str | None:
    """The defect of a pair, None if it is sound. Order: empty, refusal, copied, truncated, other_language."""
    if is_empty(answer):
        return "empty"
    request = request or ""
    told, words = instruction(request), tokens(answer)
    if is_refusal(answer, request, words):
        return "refusal"
    if is_copy(answer, request, told, words):
        return "copied"
    if is_truncated(answer, request):
        return "truncated"
    if in_other_language(answer, told):
        return "other_language"
    return None


def _defects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [defect(a, r) for a, r in zip(batch["answer"], batch["request"])]
        out = pd.DataFrame({"response_id": batch["response_id"], "defect": pd.Series(found, dtype="object", index=batch.index)})
        yield out[out["defect"].notna()]


def broken_pairs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(response_id, defect) of every defective pair.

    requests: custom_id and body.messages; responses: response_id, custom_id and response in either layout. Repeated rows count
    once by their key; responses whose custom_id is null or unknown form no pair; a null response or content is empty; a request
    without user message has no instruction, so only empty, refusing and truncated answers show; other columns are not read.
    A custom_id with very many responses is joined by broadcast of its one request.
    """
    users = F.filter("body.messages", lambda m: m["role"] == "user")
    asked_for = requests.where("custom_id is not null").select("custom_id", F.concat_ws("\n\n", F.transform(users, lambda m: m["content"])).alias("request"))
    asked_for = once(asked_for, "custom_id")
    first = F.coalesce(F.get("response.body.choices", F.lit(0))["message"]["content"], F.get("response.choices", F.lit(0))["message"]["content"])
    given = responses.where("custom_id is not null").select("response_id", "custom_id", first.alias("answer"))
    counts = given.groupBy("custom_id").agg(F.count(F.lit(1)).alias("_n"))
    pairs = join_hot(given, stored(asked_for.join(counts, "custom_id"), "requests"), "custom_id", "_n")
    found = pairs.select("response_id", "answer", "request").mapInPandas(_defects, "response_id bigint, defect string")
    return once(found, "response_id")  # repeated responses, judged alike, are few: their defects move instead of all answers
