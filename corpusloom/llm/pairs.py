"""Broken prompt and response pairs (problem 2).

Method: responses are sorted by text and neighbours' common prefixes compared, which finds shortened versions: evidence of a
cut is that one breaks off inside a word of its longer version, or that it has a longer version for the same prompt; the
same comparison over the sorted tails of all responses tells broken words.  Spikes of the length distribution give limits at
which answers are cut; the posterior of a cut combines these (see ``truncation``).  Then rules for copies, refusals and
languages apply.  Each defective pair gets one defect, the first that holds of:

* ``empty``: null, blank, a placeholder or nothing but an error message;
* ``refusal``: after a courtesy, every sentence declines or excuses the declining;
* ``copy``: most word runs of the answer stand in the prompt, unless the prompt asks for a copy;
* ``truncated``: the answer stops before its end (posterior over one half);
* ``language``: most of the answer is in another language than the prompt's, or than the one it asks for.

``status`` and ``error`` decide nothing, but a response that repeats its own ``error`` is an error message.

The sort is a range partitioning of the distinct texts, so equal texts are one row and no prefix makes a hot partition;
neighbours across partitions meet through one row per partition.  Repeated rows of a call count once; if they disagree
the row ingested last holds.  Null and blank ids give nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ids import clean_id
from corpusloom.llm import truncation
from corpusloom.llm.language import language
from corpusloom.llm.sentences import units_of
from corpusloom.session import Stages

#: Texts that hold no answer, lower case, without outer marks.
PLACEHOLDERS = frozenset(
    "|n/a|na|none|null|nil|nan|tbd|todo|tba|{}|no response|no answer|empty|answer|answer:|response|response:|output|output:|<answer></answer>|<response></response>|undefined|placeholder|lorem ipsum|réponse|antwort|respuesta|回答|答案|无|なし".split("|")
)
_TAGS = re.compile(r"<[^<>]*>")
_ERROR = re.compile(r"^\[?(?:llm )?(?:error|exception|traceback|failure|fehler|erreur)\b[^\n]{0,200}$", re.I)
#: The same over any length and several lines: a header with its message, then nothing but stack frames, causes and fields.
_LONG_ERROR = re.compile(
    r"^\[?(?:llm )?(?:traceback \(most recent call last\):|(?:[\w.]*(?:error|exception|failure)|fehler|erreur)(?: \w{1,20})?\s*[:\]])[^\n]*"
    r"(?:\n(?>(?:[ \t\r]*|[ \t]+\S[^\n]*|at [^\n]*|file \"[^\n]*|caused by\b[^\n]*|during handling of [^\n]*|the above exception [^\n]*|traceback \([^\n]*|[\w.]*(?:error|exception)\b:?[^\n]*|[\w-]+(?: id| code)?\s*[:=] ?\S+)(?=\n|$)))*+$",
    re.I,
)
#: Messages of failed calls that stand for a response.
_FAILURES = re.compile(r"^(?:request timed out|connection reset|rate limit|context length exceeded|upstream closed|service unavailable|internal server error|bad gateway)[^\n]{0,80}$", re.I)
#: Fixed patterns: sentences that decline.
_DECLINE = re.compile(
    r"""\b(?:can(?:'|’)?t|cannot|can\ not|(?:am|'m|’m|be)\ (?:un|not\ )able\ to|won(?:'|’)t\ be\ able\ to)\b.{0,30}\b(?:help|assist|answer|respond|comply|do|carry|provide|discuss|support|fulfil|with\ (?:this|that))
    |\b(?:have\ to|must|need\ to|will)\ (?:decline|refuse|pass\ on)|\brather\ not\b|\bnot\ something\ I\ can\b|\bguidelines\ do\ not\b|\bI\ leave\ to\ others\b|\bwrong\ of\ me\ to\b
    |^I\ (?:will|shall)\ not\ (?:describe|discuss|write|answer|rate|help|comment)\b.*\bfor\ you\b|\bI\ stay\ away\ from\b|\bagainst\ my\ (?:policy|guidelines)
    |\bnicht\ helfen\b|\bmuss\ ich\ ablehnen\b|\bdarf\ ich\ nicht\b|\bkann\ ich\ (?:leider\ )?nicht\b.*\b(?:beantworten|helfen|übernehmen)
    |\bne\ (?:peux|puis)\ pas\ (?:répondre|aider|traiter)\b|\bdois\ (?:décliner|refuser)\b|\bm(?:'|’)est\ impossible\ d|\bimpossible\ de\ répondre
    |\bno\ puedo\ (?:ayudar|responder|atender)\b|\bdebo\ (?:rechazar|declinar)\b|\bno\ me\ es\ posible\b
    |お応えできません|お答えできません|お手伝いできません|控えさせていただきます|対応できません|不能回答|无法(?:协助|回答|处理|提供)|超出了我|不便回答|拒绝回答|できかねます""",
    re.I | re.X,
)
#: One of these stands in every sentence that declines; a search for them is quick.
_HINTS = tuple(
    "can't|can’t|cannot|can not|unable|not able|won't|won’t|decline|refuse|pass on|rather not|something i|guidelines|leave to|wrong of me|will not|shall not|stay away|policy|helfen|ablehnen|ich nicht|ich leider|pas répondre|pas aider|pas traiter|décliner|refuser|impossible|no puedo|rechazar|declinar|no me es|できません|控え|できかねます|不能|无法|超出|不便|拒绝".split("|")
)
#: Fixed patterns: sentences that excuse it or lead away, and courtesies before it.
_EXCUSE = re.compile(
    r"""\bI\ cannot\ support\b|\bI\ may\ discuss\b|\btopics?\ I\ avoid\b|\bdo\ not\ have\ access\b|\btry\ (?:a\ different|another)\b|\banything\ else\b|\bask\ a\ (?:specialist|professional)\b|^thank\ you\ for\b|^(?:I(?:'|’)?m\ )?sorry\b.{0,12}$
    |andere\ Frage|außerhalb\ meiner|Möglichkeiten\b|autre\ question|sort\ de\ mon\ cadre|otra\ pregunta|fuera\ de\ mi\ alcance|不在我的|换一个问题|対応範囲|別の質問|merci\ (?:pour|d)|danke\ für|gracias\ por""",
    re.I | re.X,
)
#: Fixed patterns: prompts that ask for a copy or for another language.
_ASKS_COPY = re.compile(
    r"word for word|verbatim|return it in full|correct the (?:spelling|grammar|typos)|proofread|wortwörtlich|wort für wort|mot pour mot|palabra por palabra|逐字|原样|一字一句|そのまま"
    r"|^(?:please )?(?:repeat|copy|quote) (?:the|this)\b|^(?:wiederhole|répète|répétez|recopie|repite|repita|copia)\b|繰り返して",
    re.I | re.M,
)
_LANGUAGES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "russian": "ru", "chinese": "zh", "japanese": "ja", "arabic": "ar", "hindi": "hi", "thai": "th", "korean": "ko",
    "englisch": "en", "deutsch": "de", "französisch": "fr", "spanisch": "es", "chinesisch": "zh", "japanisch": "ja", "anglais": "en", "allemand": "de", "français": "fr", "espagnol": "es", "chinois": "zh", "japonais": "ja",
    "inglés": "en", "alemán": "de", "francés": "fr", "español": "es", "chino": "zh", "japonés": "ja", "英文": "en", "英语": "en", "德语": "de", "法语": "fr", "中文": "zh", "日语": "ja", "英語": "en", "ドイツ語": "de", "フランス語": "fr", "スペイン語": "es", "中国語": "zh", "日本語": "ja",
}
_LATIN_NAMES = frozenset(n for n in _LANGUAGES if n[0] < "\u0250")
_OTHER_NAMES = tuple(n for n in _LANGUAGES if n[0] >= "\u0250")
_NAMES = "|".join(sorted(map(re.escape, _LANGUAGES), key=len, reverse=True))
_ASKS_LANGUAGE = re.compile(
    rf"\b(?:in|into|to|auf|ins|en|al?)\s+({_NAMES})\b|\b({_NAMES})\s+(?:answer|reply|response|please)|(?:用|成|为|に|で)({_NAMES})|({_NAMES})(?:回答|で答え|に翻訳|作答)", re.I
)
_WORD = re.compile(r"[぀-ヿ一-鿿ก-๎]|[^\W_]+")
_FENCED = re.compile(r"```.*?(?:```|$)", re.S)
_QUOTED_LINE = re.compile(r"^\s*>.*$", re.M)
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」")
RUN = 4
COPIED = 0.8


def is_empty(response: str | None, error: str | None) -> bool:
    if response is None:
        return True
    t = response.strip()
    if not any(c.isalnum() for c in t):
        return t != "[]"
    if error and t.lower() == error.strip().lower():
        return True
    if t[0] == "<" and not any(c.isalnum() for c in _TAGS.sub("", t)):
        return True
    bare = t.strip("*_#>-–—`()[] \t\r\n").lower()
    if bare in PLACEHOLDERS or bare.rstrip(":.") in PLACEHOLDERS:
        return True
    return bool(_ERROR.match(t) or _FAILURES.match(t) or _LONG_ERROR.match(t))


def holds_text(response: str | None, error: str | None) -> bool:
    return not is_empty(response, error)


def is_refusal(response: str) -> bool:
    low = response.lower()
    if not any(h in low for h in _HINTS) or not _DECLINE.search(response):
        return False
    units = [response[a:b] for a, b in units_of(response)]
    declines = [bool(_DECLINE.search(u)) for u in units]
    return any(declines) and all(d or _EXCUSE.search(u) for d, u in zip(declines, units))


def instruction(prompt: str) -> str:
    """A prompt without its quoted material: fenced blocks, quoted lines and what stands in quotation marks."""
    text = _FENCED.sub(" ", prompt) if "```" in prompt else prompt
    text = _QUOTED_LINE.sub("", text) if ">" in text else text
    return _QUOTED.sub(" ", text) if any(q in text for q in "\"“„«「") else text


def is_copy(prompt: str, words: list[str], asked: list[str]) -> bool:
    """``words`` and ``asked``: the words of response and prompt, in lower case."""
    if len(words) < RUN or not asked:
        return False
    known = set(asked)
    if sum(w in known for w in words) < 0.85 * len(words):
        return False
    if _ASKS_COPY.search(instruction(prompt)):
        return False
    runs = {tuple(asked[i : i + RUN]) for i in range(len(asked) - RUN + 1)}
    mine = [tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]
    share = sum(r in runs for r in mine) / len(mine)
    # short prompts: the seams between a repeated question and passage weigh more
    joined, parts = " ".join(words), [" ".join(_WORD.findall(p.lower())) for p in prompt.split("\n") if p.strip()]
    whole = [p for p in parts if len(p) >= 12 and p in joined]
    covered = sum(len(p) for p in set(whole)) >= 0.8 * len(joined)
    enough = len(words) >= 6 or len(words) >= RUN and any(joined == p for p in parts)
    return enough and (share >= COPIED or covered and share >= 0.5)


def asked_language(prompt: str, asked: list[str]) -> str:
    """The language a prompt asks for; ``asked``: its words.  Only prompts that name one are searched."""
    if _LATIN_NAMES.isdisjoint(asked) and (prompt.isascii() or not any(n in prompt for n in _OTHER_NAMES)):
        return ""
    m = _ASKS_LANGUAGE.search(instruction(prompt))
    if m:
        return _LANGUAGES[next(g for g in m.groups() if g).lower()]
    return ""


def is_foreign(prompt: str, response: str, words: list[str], asked: list[str]) -> bool:
    """Whether most of the answer is in another language than it should be."""
    fenced = "```" in response
    text = _FENCED.sub(" ", response) if fenced else response
    if text.lstrip()[:1] in "[{|":
        return False
    got = language(text, None if fenced else Counter(words))
    if not got:
        return False
    want = asked_language(prompt, asked) or language(prompt, Counter(asked))
    return bool(want) and got != want


def rules(prompt: str | None, response: str | None, error: str | None) -> str | None:
    """The defect by the rules other than truncation."""
    if is_empty(response, error):
        return "empty"
    if is_refusal(response):
        return "refusal"
    if not prompt:
        return None
    words, asked = _WORD.findall(response.lower()), _WORD.findall(prompt.lower())
    if is_copy(prompt, words, asked):
        return "copy"
    return "language" if is_foreign(prompt, response, words, asked) else None


def features(prompt: str | None, response: str | None, error: str | None) -> tuple:
    """(defect by the rules, then ``truncation.evidence`` of what may be an answer)."""
    defect = rules(prompt, response, error)
    return defect, *truncation.evidence(response, defect in (None, "language"))


def shortened(calls: DataFrame, by_prompt: bool = False) -> DataFrame:
    """(part, kind, text, p, inword) of the responses that are proper beginnings, of two words or more, of another response
    (``by_prompt``: of one to the same prompt, whose hash is p), and the first and last texts of each partition.

    Distinct texts are sorted by range; in sorted order a beginning is followed by a longer version of itself.  Blanks sort
    before letters, so if that one goes on inside a word (``inword``) all do.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, None
        rows: list[tuple] = []
        for batch in batches:
            for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if before is None:
                    first = now
                elif before[0] == now[0] and _begins(before[1], now[1]):
                    rows.append((1, *before, _in_word(before[1], now[1])))
                before = now
            yield _out(rows)
            rows = []
        if before is not None:
            yield _out([(2, *first, False), (3, *before, False)])

    def _out(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())],
            names=["part", "kind", "text", "p", "inword"],
        )

    prompt = prompt_key() if by_prompt else F.lit(0).cast("bigint")
    texts = calls.select(prompt.alias("p"), F.rtrim("response_text").alias("text")).filter("text != '' AND p IS NOT NULL").groupBy("p", "text").agg(F.lit(1).alias("one")).select("p", "text")
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartitionByRange(n, "p", "text").sortWithinPartitions("p", "text").mapInArrow(scan, "part int, kind int, text string, p bigint, inword boolean")


def prompt_key() -> Column:
    """A hash of the prompt; null without one."""
    return F.when(F.trim("prompt_text") != "", F.xxhash64(F.rtrim("prompt_text")))


def _begins(short: str, long: str) -> bool:
    return len(long) > len(short) and long.startswith(short) and (" " in short.strip() or not short.isascii())


def _in_word(short: str, long: str) -> bool:
    """Whether the shorter text ends inside a word of the longer, in scripts with blanks."""
    a, b = short[-1], long[len(short)]
    return a.isalpha() and b.isalpha() and not truncation._CJK.search(a + b)


def _edges(found: DataFrame) -> DataFrame:
    """The beginnings, with those whose longer version begins the next partition.  One first and one last row per partition reach the driver."""
    edges = sorted((r.part, r.kind, r.p, r.text) for r in found.filter("kind > 1").collect())
    extra = []
    for (_, ka, pa_, a), (_, kb, pb, b) in zip(edges, edges[1:]):
        if ka == 3 and kb == 2 and pa_ == pb and _begins(a, b):
            extra.append((a, pa_, _in_word(a, b)))
    inner = found.filter("kind = 1").select("text", "p", "inword")
    return inner.unionByName(inner.sparkSession.createDataFrame(extra, "text string, p bigint, inword boolean")) if extra else inner


#: What a beginning weighs as evidence of a cut, as a log ratio: inside a word of its longer version, or beside a longer answer to the same prompt.
BROKEN, AGAIN = 12.0, 9.0


def defects(calls: DataFrame) -> DataFrame:
    """(trace_id, stage, defect) of every call; defect null where there is none."""
    stages = Stages(calls.sparkSession, "pairs")
    cols = calls.select(
        clean_id("trace_id").alias("trace_id"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.coalesce("stage", F.lit("unknown")).alias("source"), F.xxhash64(F.rtrim("response_text")).alias("h"),
        F.col("completion_tokens").cast("bigint").alias("tokens"), prompt_key().alias("p"), "prompt_text", "response_text", "error",
    ).filter("trace_id IS NOT NULL")
    each, counts = truncation.scan(cols, "trace_id string, ingested_at timestamp, source string, h bigint, tokens bigint, p bigint", 6, 7, features, "defect string, " + truncation.EVIDENCE)
    # beginnings of longer responses are evidence of a cut beside the ending, the lengths and the tokens
    short = _edges(stages.cut(shortened(calls))).groupBy(F.xxhash64("text").alias("h")).agg(F.max("inword").alias("broken"))
    again = _edges(stages.cut(shortened(calls, by_prompt=True))).select("p", F.xxhash64("text").alias("h"), F.lit(True).alias("again")).distinct()
    begun = each.join(short, "h", "left").join(again, ["p", "h"], "left")
    hints = F.when(F.col("again"), AGAIN).otherwise(0.0) + F.when(F.col("broken"), BROKEN).otherwise(0.0)
    judged = truncation.judged(begun, counts, hints).withColumn("defect", F.when(F.col("own") & (F.col("cut") > 0.5), "truncated").otherwise(F.col("defect")))
    last = judged.groupBy("trace_id").agg(F.max_by(F.struct("source", "defect"), F.struct("ingested_at", "h")).alias("r"))
    return last.select("trace_id", F.col("r.source").alias("stage"), F.col("r.defect").alias("defect"))
