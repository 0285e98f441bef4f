"""Answers that are no usable answer to their prompt, each with its kind of defect.

An answer is ``empty``, ``copied`` from the prompt, a ``refusal``, in an ``other_language`` than
the prompt asks for, or ``truncated``; the rules are tried in this order and the first holds.
Languages are told by :mod:`pathloom.llm.language`; the one asked for is the last that the whole
prompt requests (a language merely mentioned isn't requested), else that of its last line.

Truncation is judged against the other answers. Names, numbers and times are masked, the distinct
masked texts are sorted over the whole cluster, and one that is a prefix of its neighbour is a
shortened version of it. Answers closed by a stop show how sound answers end; an answer without a
stop is taken as cut off if it is a shortened version, or ends as sound answers only do in their
middle, or inside a word, or after an opening or joining mark, or at a length where answers
without a stop pile up. A missing stop alone is no defect.

Defined cases: a null answer, or one of blanks, invisible characters and punctuation, is empty;
a null prompt asks for no language and can't be copied; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathloom.llm.charform import convert
from pathloom.llm.language import languages
from pathloom.storage import cut

# How a refusal opens, per language; matched at the start of the answer, in lower case.
REFUSALS = [
    r"(?:i'?m|i am) (?:very |so |really )?(?:sorry|afraid)\b.{0,40}\b(?:can'?t|cannot|can not|unable|not able|won'?t|not allowed|must decline|isn'?t anything)",
    r"(?:sorry|apologies|unfortunately|regrettably)\b.{0,40}\b(?:can'?t|cannot|can not|unable|not able|won'?t|not allowed|must decline|have to decline|isn'?t anything|is nothing)",
    r"i (?:can'?t|cannot|can not|won'?t|will not|am unable to|am not able to|am not allowed to|must decline|have to decline|decline|refuse) (?:to )?(?:help|assist|answer|provide|give|say|share|guess|infer|speculate|comment|respond|do that|comply)",
    r"i (?:must|have to) (?:decline|refuse)",
    r"as an? (?:ai |virtual |language )*(?:assistant|model|ai)\b.{0,30}\b(?:can'?t|cannot|not able|unable|not allowed|won'?t|must not)",
    r"(?:it|this|that) (?:would|will) not be (?:appropriate|right|proper|possible) for me\b",
    r"(?:this|that) is (?:something|nothing) i (?:won'?t|can'?t|cannot|can|will not|would not|may not)",
    r"(?:my |our )?(?:sincere |deepest )?apolog(?:ies|i[sz]e)\b.{0,80}\b(?:can'?t|cannot|unable|not able|outside|beyond|not permitted|not allowed|decline)\b",
    r"(?:this|that|your) (?:request|question|topic) (?:is|falls|lies|goes) (?:outside|beyond)\b.{0,40}\b(?:permitted|allowed|able|scope|can)\b",
    r"i(?:'m| am) not (?:able|allowed|permitted|authori[sz]ed|in a position) to\b",
    r"(?:je suis |nous sommes )?(?:vraiment |sincèrement )?(?:désolée?s?|navrée?s?)\b.{0,60}\bne (?:peux|peut|pouvons|puis|suis)\b",
    r"(?:malheureusement|je regrette)\b.{0,50}\bne (?:peux|puis|suis|pouvons)\b|je ne (?:peux|puis) pas (?:vous |t'|y |te )?(?:aider|répondre|fournir|dire|donner)",
    r"(?:es )?tut mir (?:sehr |wirklich )?leid\b.{0,60}\b(?:nicht|kein\w*)\b|(?:leider|entschuldigung|bedaure)\b.{0,60}\b(?:kann|darf|können)\b.{0,40}\b(?:nicht|kein\w*)\b",
    r"ich (?:kann|darf|möchte) (?:ihnen |dir |das |diese |dabei |darauf ){0,2}(?:leider )?nicht (?:dabei )?(?:helfen|beantworten|antworten|sagen)",
    r"(?:mi dispiace|spiacente|purtroppo)\b.{0,50}\bnon (?:posso|sono|è possibile)\b|(?:desculpe|lamento|sinto muito|infelizmente)\b.{0,50}\bnão (?:posso|é possível|consigo)\b",
    r"(?:申し訳|すみません|ごめん|恐れ入り).{0,40}(?:できません|できかね|お答えでき|いたしかね)",
    r"(?:죄송|미안|유감).{0,40}(?:없습니다|어렵습니다|못합니다|할 수 없)",
    r"(?:抱歉|对不起|很遗憾|不好意思|非常抱歉|十分抱歉|很抱歉|恕我)[,，。\s]*(?:但)?(?:我|该|这|本|此|您|你|恕).{0,14}(?:无法|不能|不便|恕不|恕难|拒绝|超出)(?!去|来|到)",
    r"(?:作为|身为).{0,8}(?:助手|模型|助理|人工智能|ai)[,，]?.{0,6}(?:没有办法|无法|不能|不便|不可以|不会)",
    r"(?:出于|由于|因为|基于).{0,10}(?:考虑|原因|规定|政策|保护)[,，]?.{0,4}(?:拒绝|无法|不能|不便|恕)",
    r"(?:我|恕)(?:拒绝|无法回答|不能回答|不便|无法提供|不能提供|难从命)",
    r"(?:lo siento|perd[oó]n|disculp[ae]|lamentablemente|desafortunadamente|lo lamento)\b.{0,24}\b(?:no puedo|no me es posible|no es posible|no voy a|debo negarme|no estoy autorizad)",
    r"(?:me temo|lamento) (?:que |tener que )?.{0,12}\b(?:negarme|no puedo|no es posible|no me es posible)",
    r"como (?:un |una )?(?:asistente|modelo|ia)\b.{0,16}\bno\b",
    r"por (?:motivos|razones|cuestiones) de \w+,? no\b",
    r"no (?:puedo|me es posible|voy a|quiero) (?:ayudar|responder|contestar|opinar|adivinar|decir|dar|ofrecer|proporcionar)",
    r"debo (?:negarme|rechazar|declinar)",
    r"(?:извините|простите|к сожалению|сожалею|прошу прощения)\b.{0,30}(?:не могу|не вправе|не имею|невозможно|вынужден|не буду)",
    r"(?:как|будучи) .{0,16}(?:ассистент|помощник|модель).{0,16}не (?:могу|вправе|имею|буду)",
    r"я (?:не могу|не вправе|не буду|отказываюсь|вынужден отказ)",
]
# Names of languages as prompts write them.
LANGUAGE_NAMES = {
    "en": "english inglés ingles anglais englisch 英文 英语 английском английски",
    "zh": "chinese mandarin chino mandarín chinois chinesisch 中文 汉语 普通话 китайском китайски",
    "es": "spanish español espanol castellano espagnol spanisch 西班牙语 西班牙文 испанском испански",
    "ru": "russian ruso russe russisch 俄语 俄文 русском русски",
    "fr": "french francés frances français französisch 法语 法文 французском французски",
    "de": "german alemán aleman allemand deutsch 德语 德文 немецком немецки",
    "it": "italian italiano italien italienisch 意大利语 意大利文 итальянском итальянски",
    "pt": "portuguese portugués portugues português portugais portugiesisch 葡萄牙语 葡萄牙文 португальском португальски",
    "ja": "japanese japonés japones japonais japanisch 日语 日文 日本語 японском японски",
    "ko": "korean coreano coréen koreanisch 韩语 韩文 한국어 корейском корейски",
}
# How a prompt asks for a language, around its name (NAME).
REQUESTS = [
    r"\b(?:in|into|as|using)\s+(?:(?:a|an|one|two|three|single|short|plain|simple|only|just|brief|good|\d+)\s+){0,3}NAME\b(?=\s*(?:$|[^\w\s]|\x00|(?:sentences?|words?|only|please|and|with|phrases?|text|language|answer|reply)\b))",
    r"\bNAME\s+(?:\w+\s+)?(?:sentences?|answers?|reply|response|words|only|please)\b",
    r"\b(?:answer|reply|respond|write|speak|use)\s+(?:\w+\s+)?NAME\b(?=\s*(?:$|[^\w\s]|\x00|only\b|please\b))",
    r"\b(?:en|auf)\s+(?:(?:idioma|lengua|langue)\s+)?NAME\b",
    r"(?:用|以|写成|说成|译成|成)[^\x00\n。？！?!]{0,6}?NAME|NAME(?:回答|回复|作答|说明|写|表达)",
    r"\b(?:на|по)[\s-]+(?:\w+\s+){0,2}?NAME",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS))
_NAMED = {name: language for language, names in LANGUAGE_NAMES.items() for name in names.split()}
_REQUEST = re.compile("|".join(x.replace("NAME", f"({'|'.join(sorted(map(re.escape, _NAMED), key=len, reverse=True))})") for x in REQUESTS))
_TOKEN = re.compile(r"\d+(?:[:.]\d+)*|[㐀-䶿一-鿿]|[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\w\s]|_")
_NUMBER, _DOTS = re.compile(r"\d+(?:[:.]\d+)*"), re.compile(r"\.\.+$")
_STOP_MARKS, _CLOSERS = ".。!?！？", "\"”»」』)） \t\r\n\x0b\x0c\u3000"
_STOPS = frozenset(_STOP_MARKS)
#: Answers judged at a time, which bounds a worker's memory whatever the Arrow batch holds.
CHUNK = 2000
_JOINING = frozenset(",，、;；:：-—(（\"“")
_MARKS = frozenset(",，、;；:：。.!?！？")

FEATURES = T.StructType([
    T.StructField("defect", T.StringType()), T.StructField("masked", T.StringType()), T.StructField("stop", T.BooleanType()),
    T.StructField("ending", T.StringType()), T.StructField("opening", T.StringType()), T.StructField("last2", T.StringType()),
    T.StructField("joined", T.BooleanType()), T.StructField("length", T.IntegerType()),
])
_KINDS = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]


def _requested(line: str) -> str | None:
    """The language that a line asks for last."""
    last = None
    for m in _REQUEST.finditer(line.lower()):
        last = m
    return _NAMED[last[last.lastindex]] if last else None


def asked_languages(prompts: list[str]) -> list[str | None]:
    """The language each prompt asks for: the last request in the whole prompt, else that of its last line.

    Prompts are read line by line from their end until one asks; lines that recur are read once.
    """
    lines = [p.strip().split("\n") for p in prompts]
    found: list[str | None] = [None] * len(prompts)
    known: dict[str, str | None] = {}
    left, back = list(range(len(prompts))), 1
    while left:
        new = [t for t in dict.fromkeys(lines[i][-back] for i in left) if t not in known]
        known.update(zip(new, map(_requested, convert(pa.array(new, pa.large_string()), "form").to_pylist())))
        for i in left:
            found[i] = known[lines[i][-back]]
        left, back = [i for i in left if found[i] is None and back < len(lines[i])], back + 1
    open_ = [i for i, language in enumerate(found) if language is None and prompts[i].strip()]
    for i, language in zip(open_, languages([lines[i][-1] for i in open_])):
        found[i] = language
    return found


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """A first word of a text, and a word inside it that begins with a capital."""
    capital = "".join(chr(c) for c in range(0x250) if chr(c).isupper()) + "".join(chr(c) for c in (*range(0x370, 0x530), *range(0x1E00, 0x2000)) if chr(c).isupper())
    word = r"[^\W\d_㐀-䶿一-鿿]+(?:['’-][^\W\d_㐀-䶿一-鿿]+)*"
    return re.compile(rf"(?:^|(?<=\x00))\s*{word}"), re.compile(rf"(?<![^\W\d_])(?<!['’-])[{capital}](?:[^\W\d_㐀-䶿一-鿿]*)(?:['’-][^\W\d_㐀-䶿一-鿿]+)*")


def _masked(texts: list[str]) -> list[list[str]]:
    """Tokens of every text with numbers and names as placeholders; ideographs stand alone.

    The texts are one string for the patterns; no step but the last looks at single tokens.
    """
    first, name = _patterns()
    joined = "\x00".join(t.replace("\x00", " ") for t in texts)
    joined = first.sub(lambda m: m[0].lower(), joined)
    joined = name.sub("W", _NUMBER.sub("0", joined))
    return [own.split() for own in " ".join(_TOKEN.findall(joined)).split("\x00")] if texts else []


def _ending(tokens: list[str]) -> tuple[str, str | None]:
    """How a text ends: its last clause by opening and closing ideographs, or its last three tokens."""
    if not tokens or max(tokens) < "㐀":
        return "w|" + " ".join(["^", *tokens][-3:]), None
    if re.match(r"[㐀-䶿一-鿿]", tokens[-1]) or sum(len(t) == 1 and t >= "㐀" for t in tokens) > len(tokens) / 2:
        start = max((i + 1 for i, t in enumerate(tokens[:-1]) if t in _MARKS), default=0)
        clause = tokens[start:]
        opening = "h|" + "".join(clause[:2])
        return f"{opening}|{''.join(clause[-2:])}", opening
    return "w|" + " ".join(["^", *tokens][-3:]), None


def _copied(key: str, lines: list[str]) -> bool:
    """Whether an answer is made of lines of the prompt, its question (the last one) among them."""
    if not lines or lines[-1] not in key:
        return False
    if key in "".join(lines):
        return True
    rest = key.replace(lines[-1], "", 1)
    for line in lines[:-1]:
        rest = rest.replace(line, "", 1)
    return not rest


def _judged(text: str) -> tuple[bool, str, bool]:
    """Whether a text is closed by a stop, what is left to compare, and whether it ends in the air."""
    dots = _DOTS.search(text)
    body = text[: dots.start()].rstrip() if dots else text
    bare = body.rstrip(_CLOSERS)
    stop = not dots and bool(bare) and bare[-1] in _STOPS
    return stop, bare.rstrip(_STOP_MARKS) if stop else body, bool(dots) or bool(body) and body[-1] in _JOINING


def _features(answers: pa.Array, asked: pa.Array) -> pa.Array:
    prompts = [(p or "").strip() for p in asked.to_pylist()]
    questions = [p.rsplit("\n", 1)[-1] for p in prompts]
    each = list(dict.fromkeys(questions))
    asked_key = dict(zip(each, convert(pa.array(each, pa.large_string()), "reduce").to_pylist()))
    last = [asked_key[q] for q in questions]
    keys = convert(answers, "reduce").to_pylist()
    defect: list[str | None] = [None if k else "empty" for k in keys]
    # Only an answer that holds the question can be a copy: the other lines are reduced for those alone.
    maybe = [i for i, (q, k) in enumerate(zip(last, keys)) if q and k and q in k]
    split = [prompts[i].split("\n") for i in maybe]
    reduced_lines = iter(convert(pa.array([line for own in split for line in own], pa.large_string()), "reduce").to_pylist())
    for i, own in zip(maybe, split):
        if _copied(keys[i], [k for k in (next(reduced_lines) for _ in own) if k]):
            defect[i] = "copied"
    texts = [(t or "").strip() for t in convert(answers, "form").to_pylist()]
    for i, text in enumerate(texts):
        if defect[i] is None and _REFUSAL.match(text.lower().lstrip("-*>#\"“'· ")):
            defect[i] = "refusal"
    open_ = [i for i, d in enumerate(defect) if d is None]
    wanted = asked_languages([prompts[i] for i in open_])
    for i, want, found in zip(open_, wanted, languages([texts[i] for i in open_], wanted)):
        if want and found and want != found:
            defect[i] = "other_language"
    judged = [i for i in open_ if defect[i] is None]
    ends = [_judged(texts[i]) for i in judged]
    rows: list[tuple] = [(d,) + (None,) * 7 for d in defect]
    for i, (stop, _, joined), tokens in zip(judged, ends, _masked([e[1] for e in ends])):
        ending, opening = _ending(tokens)
        rows[i] = (None, " ".join(tokens), stop, ending, opening, " ".join(tokens[-2:]), joined, len(texts[i]))
    columns = [list(c) for c in zip(*rows)] if rows else [[]] * len(_KINDS)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=FEATURES.names)


@F.arrow_udf(FEATURES)
def features(answers: pa.Array, asked: pa.Array) -> pa.Array:
    return pa.concat_arrays([_features(answers.slice(at, CHUNK), asked.slice(at, CHUNK)) for at in range(0, len(answers), CHUNK)]) if len(answers) else _features(answers, asked)


def last_content(messages: str, role: str) -> Column:
    """Content of the last message of a role."""
    own = F.filter(messages, lambda m: m.role == role)
    return F.get(own, F.size(own) - 1).content


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: does the next text begin with this one; the first and the last text."""
    last, texts, longer, first = None, [], [], None
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if last is None:
                first = text
            else:
                texts.append(last)
                longer.append(text.startswith(last))
            last = text
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(longer, pa.bool_()), pa.nulls(len(texts), pa.string())], ["masked", "longer", "first"])
        texts, longer = [], []
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.nulls(1, pa.bool_()), pa.array([first], pa.string())], ["masked", "longer", "first"])


def shortened(masked: DataFrame) -> DataFrame:
    """``masked, longer``: for every distinct text, whether another one continues it.

    The texts are sorted over the cluster and compared with their neighbours; the last text of a
    partition is compared with the first of the next one (a row per partition).
    """
    texts = masked.select("masked").distinct()
    ordered = texts.repartitionByRange("masked").sortWithinPartitions("masked")
    compared = cut(ordered.mapInArrow(_neighbours, "masked string, longer boolean, first string"), "neighbours")
    seams = compared.where("longer IS NULL").select("masked", F.lead("first").over(W.orderBy("masked")).alias("next"))
    seams = seams.select("masked", F.coalesce(F.expr("startswith(next, masked)"), F.lit(False)).alias("longer"))
    return compared.where("longer IS NOT NULL").select("masked", "longer").unionByName(seams)


def defects(answers: DataFrame, ids: list[str], answer: str, asked: str) -> DataFrame:
    """``ids`` and ``defect`` of every defective answer."""
    rows = cut(answers.select(F.struct(*ids).alias("_ids"), features(answer, asked).alias("f")).select("_ids", "f.*"), "answers")
    plain = rows.where("defect IS NULL")
    # Masked texts recur: what is learned from them is counted once per text and not per answer.
    texts = cut(plain.groupBy("masked", "stop", "ending", "opening", "last2").agg(F.count(F.lit(1)).alias("n")), "masked")
    sound, open_ = texts.where("stop"), plain.where("NOT stop")
    ends = sound.groupBy("ending").agg(F.sum("n").alias("n_ending"))
    full = sound.select("masked").distinct().withColumn("whole", F.lit(True))
    kinds = sound.where("opening IS NOT NULL").groupBy("opening", "last2").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("opening").agg((F.count(F.lit(1)) > 0.3 * F.sum("n")).alias("varied"), F.sum("n").alias("n_opening")).where("n_opening >= 5")
    tokens = F.split("masked", " ")
    inner = sound.where(F.size(tokens) > 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.concat_ws(" ", tokens[i - 1], tokens[i]))).alias("last2")).distinct().withColumn("inside", F.lit(True))
    words = texts.select(F.explode(F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - 1))).alias("word")).distinct().withColumn("known", F.lit(True))
    pile = open_.groupBy("length").agg(F.count(F.lit(1)).alias("here"))
    around = W.orderBy("length").rangeBetween(-3, 3)
    pile = pile.select("length", ((F.col("here") >= 20) & (F.col("here") > 8 * (F.sum("here").over(around) - F.col("here")) / 6)).alias("spike"))
    judged = open_.join(full, "masked", "left").join(shortened(texts), "masked", "left").join(ends, "ending", "left").join(kinds, "opening", "left").join(inner, "last2", "left")
    judged = judged.withColumn("word", F.element_at(tokens, -1)).join(words, "word", "left").join(pile, "length", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ends_sound = (F.coalesce("n_ending", F.lit(0)) >= 2) | yes(F.col("varied"))
    truncated = ~yes(F.col("whole")) & (yes(F.col("longer")) | (~ends_sound & (yes(F.col("joined")) | yes(F.col("inside")) | F.col("known").isNull() | yes(F.col("spike")))))
    cut_off = judged.where(truncated).select("_ids", F.lit("truncated").alias("defect"))
    return rows.where("defect IS NOT NULL").select("_ids", "defect").unionByName(cut_off).select("_ids.*", "defect")
