"""Garbled text from wrong character encoding (problem 8).

Best-first search over "encode as it was read, decode as it was written" and unescape steps. States are texts, visited
states are remembered by hash, and the queue is ordered by an implausibility cost of the characters. The search has no
cap on states: it ends when the queue is empty or when the best text is as
cheap as any text can be.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows without any of these cannot be garbled: a character beyond ASCII, or one written as an escape.
SUSPECT = r"[^\x00-\x7F]|&#?[0-9A-Za-z]{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[89A-Fa-f][0-9A-Fa-f]"

# (read as, written as)
STEPS = [
    *((x, "utf-8") for x in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250")),
    ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "cp1252"), ("mac_roman", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp866"), ("latin-1", "cp866"),
    ("cp1252", "cp932"), ("latin-1", "cp932"), ("mac_roman", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"),
    *((r, w) for r in ("cp1252", "latin-1") for w in ("gb18030", "big5", "cp949", "cp1250", "iso8859-2", "cp1253", "cp1254", "cp1255", "cp1256", "cp874")),
]

LOWER, UPPER = "a-zß-öø-ÿāăąćčďđēęěğģīįķľłńņňőœŕřśşšťūůűųźżž", "A-ZÀ-ÖØ-ÞŒŠŸŽĆČĎĘĚĞŁŃŇŐŘŚŞŤŮŰŹŻ"
LATIN = LOWER + UPPER
CYRILLIC = "Ѐ-ԯ"
BOX = "─-▟■-◿"
SYMBOL = "¢-©«-´¶-»¿†‡•‰‹›€™ˆ˜∂∆∏∑−√∞∫≈≠≤≥◊⁄ªº×÷¬¯¨¸ƒπΩµ⌐-⏿‚„¡Ά-ώ"

PENALTIES = [
    (5.0, re.compile(r"[\x80-\x9f\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd\ue000-\uf8ff]")),
    # a capital beyond ASCII after a small letter, a capital between small ones
    (2.0, re.compile(rf"(?<=[{LOWER}])[À-ÖØ-ÞŒŠŸŽĎĘĚĞŁŃŇŐŘŚŞŤŮŰŹŻ]")),
    (2.0, re.compile(rf"(?<=[{LOWER}А-яёЁ])[А-ЯЁЀ-Џ](?=[а-я])|(?<=[а-яё])[А-ЯЁ]")),
    # symbols that stand in words
    (2.0, re.compile(rf"(?<=[{LATIN}{CYRILLIC}])[{SYMBOL}‘“”](?=[{LATIN}{CYRILLIC}{SYMBOL}])|(?<=[{LATIN}])[©®§¶±¼½¾³²¹¸¨¯´¬ªº€™†‡•‰˜ˆ√∫∂∑∏≤≥≠≈∞∆◊⁄ƒ‚„π¤¦¥¢£¿¡«](?=[\s\W]|$)|(?<![\w$€£.,…])[€§¶©®‡†‰√∂∫≠≤≥∆∏∑™¤¦¥¢ƒ¿¡˜ˆ∞](?=[a-zà-öø-ÿ]{2})")),
    (1.5, re.compile(r"[‚ƒ„…†‡ˆ‰‹‘’“”•˜™›¡-¿×÷][‚ƒ„†‡ˆ‰‹•˜™›¡-¦¨-±²-¶¸-º¼-¾×÷](?=\S)")),
    # lead bytes of UTF-8 read as line drawing: in a word, or before what is neither a line, a blank nor a letter
    (3.0, re.compile(rf"(?<=[{LATIN}])[├┬┼┤╨╤╞╟╥╙╘╒╓╫╪](?=\S)|[├┬╨╤](?=[^\s{BOX}\w])|[├┬](?=[^\x00-\x7f{BOX}])|[╨╤][{BOX}\w]")),
    (1.0, re.compile(rf"(?<=[{LATIN}])[{BOX}](?=[{LATIN}{BOX}])")),
    (2.5, re.compile(rf"(?<=[{LATIN}])[{CYRILLIC}]|(?<=[{CYRILLIC}])[{LATIN}]")),
    # letters of Cyrillic and Latin that other readings bring forth
    (0.7, re.compile("[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЄєЇІіЅѕ]|[ÐÞðþÝ]|[\xad]")),
    # long stretches of accented Latin letters
    (1.0, re.compile("(?<=[À-ÖØ-öø-ÿ][À-ÖØ-öø-ÿ][À-ÖØ-öø-ÿ])[À-ÖØ-öø-ÿ]")),
    (0.5, re.compile("[ŸŽžŠšþð]")),
    (2.0, re.compile("(?<=[ά-ώ])[Α-Ω]")),
    # ideographs are not parted by blanks
    (1.0, re.compile("(?<=[㐀-鿿]) (?=[㐀-鿿])")),
    # kana and ideographs in Latin or Cyrillic words
    (3.0, re.compile(rf"(?<=[{LATIN}{CYRILLIC}])[぀-ヿ㐀-鿿｡-ﾟ]|[぀-ヿ㐀-鿿｡-ﾟ](?=[{LATIN}{CYRILLIC}])")),
]
#: Scripts that wrong readings bring forth as single letters; words of them are as good as any.
_RARE = re.compile("[ƀ-˅ˈ-ˏ˞-ΐϏ-ϿԀ-ݿހ-ῼⰀ-⿿㄀-ㇿ㌀-䶿ꀀ-힯豈-ﷺ︰-﻾｡-ﾟ\U00010000-\U0001f2ff\U00020000-\U0010ffff]")
_RARE_WORDS = re.compile(
    "|".join(
        # three or more letters of one script, its blanks and stops among them, that touch no letter of another
        f"(?<![{LATIN}{CYRILLIC}])[{x}](?:[{x}]|[ .,:;!?'-]+(?=[{x}]))+[{x}](?![{LATIN}{CYRILLIC}])"
        for x in ("\u0590-\u05ff", "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufefc", "\uac00-\ud7a3\u3130-\u318f", "\u10a0-\u10ff", "\u0530-\u058f", *(f"{chr(b)}-{chr(b + 127)}" for b in range(0x900, 0xE80, 0x80)))
    )
)
_VIETNAMESE = re.compile("[ƠơƯưẠ-ỹ]")
# The ten commonest letters of the languages of an alphabet.
COMMON = {"\u0400-\u052f": "оеаинтсрвлОЕАИНТСРВЛ", "\u0370-\u03ff": "αοιετσνηυρΑΟΙΕΤΣΝΗΥΡίάόέή", "\u0590-\u05ff": "יוהלאמרתבש", "\u0600-\u06ff": "اليمنورتبه", "\u0e00-\u0e7f": "านรอกเง่้ัิีมยลทดสวต"}
_ALPHABETS = [(re.compile(f"[{r}]+"), re.compile(f"[{''.join(c)}]")) for r, c in COMMON.items()]
_HAN = re.compile("[㐀-鿿]")
_SCRIPT_RUNS = re.compile("|".join([f"[{x}]+" for x in (LOWER[3:], BOX, "\u0370-\u03ff", "\u0400-\u052f", "\u0590-\u05ff", "\u0600-\u06ff\u0750-\u077f", "\u3000-\u30ff\u3400-\u9fff\uff01-\uff5e", "\uac00-\ud7a3", *(f"{chr(b)}-{chr(b + 127)}" for b in range(0x900, 0xE80, 0x80)))] + ["[^\\x00-\\x7f]"]))
_RUNS = re.compile(r"[^\x00-\x7f]+")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_ESCAPED = re.compile(r"&#?[0-9A-Za-z]{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[89A-Fa-f][0-9A-Fa-f]")
_QUOTED = re.compile(r"(?<!`)`[^`\n]{1,80}`(?!`)")
_LOST_NBSP = re.compile("Ã (?=[\\s.,;:!?)]|[a-z])|â‰ ")
# of the letters that begin with this byte only one is small and has a tail that readers drop
_LOST_SHY = re.compile(rf"(?<=[{LATIN}])Ã(?=[{LOWER}])|(?<=[{LOWER}])Ã(?=[ \t.,;:!?)]|$)")
_LONELY = re.compile(rf"Ã(?=[{LOWER}])")
MARGIN = 1.0


def _table(codec: str) -> list[str]:
    """The 256 characters of a one-byte encoding; bytes it lacks stand as control characters, as lenient readers give them."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(i))
    return out


def _tools():
    enc, utf = {}, {}
    for read, written in STEPS:
        if read not in enc:
            chars = _table(read)
            enc[read] = {ord(c): i for i, c in reversed(list(enumerate(chars)))}
            if read == "latin-1":
                enc[read] = {i: i for i in range(256)}
        if written == "utf-8":
            chars = _table(read)
            part = lambda a, b: "[" + "".join(re.escape(chars[i]) for i in range(a, b)) + "]"  # noqa: B023, E731
            # a no-break space is often turned into a blank later
            tail = part(0x80, 0xC0)
            utf[read] = re.compile(f"{part(0xC2, 0xE0)}{tail}|{part(0xE0, 0xF0)}{tail}{tail}|{part(0xF0, 0xF5)}{tail}{tail}{tail}")
    return enc, utf


ENC, UTF = _tools()
RECODES = [x for x in STEPS if x[1] != "utf-8"]
WIDE = [x for x in RECODES if x[1] in ("cp932", "euc_jp", "gb18030", "big5", "cp949")]
WESTERN = ("cp1252", "latin-1")
SCREEN = (*WESTERN, "mac_roman", "cp437", "cp850")
_WORDS = re.compile(r"[ \t\r\n]+")
_KNOWN: dict[str, bool] = {}


def cost(text: str, limit: float = math.inf) -> float:
    """Implausibility: 0.4 for each character beyond ASCII, for each run of small letters, of letters of one script that
    is not Latin or of drawn lines, a share for letters that are seldom in their script, and penalties for characters out of place.

    Counting ends as soon as the limit is passed.
    """
    c = 0.4 * len(_SCRIPT_RUNS.findall(text))
    for w, p in PENALTIES:
        if c > limit:
            return c
        c += w * len(p.findall(text))
    return c + _foreign(text) + sum(_seldom(text))


def floor(text: str) -> float:
    """What no text reached by UTF-8 or encodings of one byte can cost less than: every run beyond ASCII stays one."""
    return 0.4 * len(_RUNS.findall(text))


def penalty(text: str) -> float:
    return sum(w * len(p.findall(text)) for w, p in PENALTIES) + _foreign(text)


def _foreign(text: str) -> float:
    rare = len(_RARE.findall(text))
    return 2.0 * (rare - sum(len(_RARE.findall(m)) for m in _RARE_WORDS.findall(text)) - len(_VIETNAMESE.findall(text))) if rare else 0.0


def _seldom(text: str) -> Iterator[float]:
    for letters, common in _ALPHABETS:
        for run in letters.findall(text):
            if len(run) > 2:
                yield max(0.0, 0.15 * (0.65 * len(run) - len(common.findall(run))))
    if _HAN.search(text):
        # half of the ideographs of a legacy set are seldom used, and wrong readings hit them as often as the others
        han = _HAN.findall(text)
        yield 0.5 * sum(not _usual(c) for c in han)


def _usual(c: str) -> bool:
    """Whether an ideograph stands in the first level of one of the legacy sets."""
    known = _HAN_LEVEL.get(c)
    if known is None:
        known = False
        for codec, low, high in (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("cp932", 0x88, 0x97)):
            try:
                known |= low <= c.encode(codec)[0] <= high
            except UnicodeEncodeError:
                pass
        _HAN_LEVEL[c] = known
    return known


_HAN_LEVEL: dict[str, bool] = {}


def _utf8(text: str, read: str) -> str:
    enc = ENC[read]

    def one(m: re.Match) -> str:
        try:
            return bytes(enc[ord(c)] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()

    out = UTF[read].sub(one, text)
    if read in WESTERN and out != text and not UTF[read].search(out):
        # after no-break spaces became blanks and soft hyphens were lost, two letters remain without their tail
        out = _LOST_NBSP.sub(lambda m: bytes([*(enc[ord(c)] for c in m.group()[:-1]), 0xA0]).decode("utf-8") if all(ord(c) in enc for c in m.group()[:-1]) else m.group(), out)
        out = _LOST_SHY.sub("í", out)
    return out


def _recode(text: str, read: str, written: str) -> str | None:
    try:
        raw = text.encode(read)
    except UnicodeEncodeError:
        enc = ENC[read]
        try:
            raw = bytes(enc[ord(c)] for c in text)
        except KeyError:
            return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def _unescape(text: str) -> str:
    t = html.unescape(re.sub(r"&#(1[2-5][0-9]);", lambda m: chr(int(m[1])), text))
    t = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), t)
    return re.sub(r"%([89A-Fa-f][0-9A-Fa-f])", lambda m: chr(int(m[1], 16)), t)


def _next(text: str, recoded: bool) -> Iterator[tuple[str, bool, bool]]:
    """(text, decoded, recoded) of the neighbours: unescaped, UTF-8 undone, and once on each path one legacy encoding for another."""
    if _ESCAPED.search(text):
        t = _unescape(text)
        if t != text:
            yield t, False, recoded
    if text.isascii():
        return
    for read, pattern in UTF.items():
        if pattern.search(text):
            t = _utf8(text, read)
            if t != text:
                yield t, True, recoded
    if not recoded:
        for read, written in RECODES:
            t = _recode(text, read, written)
            if t is not None and t != text:
                yield t, True, True


def _suspicious(word: str) -> bool:
    """Whether anything about a word is out of place. All penalties look at a word and its ends only, and words recur."""
    known = _KNOWN.get(word)
    if known is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        known = _KNOWN[word] = bool(penalty(word)) or any(UTF[x].search(word) for x in SCREEN)
    return known


def repair(text: str) -> tuple[str, bool]:
    """(cheapest reachable text, whether it is the result of undoing a wrong reading) for one stretch of text.

    Undoing UTF-8 and unescaping shorten a text and legacy encodings are swapped once at most on a path, so the reachable
    texts are finite and all are visited, cheapest first, unless one is found that costs as little as any can (floor);
    then readings of two bytes a character are still tried on all that was left.
    Of equally cheap texts the one reached first holds.
    """
    escaped = _ESCAPED.search(text)
    if not escaped and not any(_suspicious(w) for w in _WORDS.split(text) if not w.isascii()):
        return text, False
    start = cost(text)
    # an escape hides its characters, so what it sets free may cost more than the escape
    plain = _unescape(text) if escaped else text
    least, best = floor(plain), None
    queue, seen = [(start, 0, text, False, False)], {hash(text)}
    reference = max(cost(plain), start) if escaped else start
    limit = reference - MARGIN
    while queue:
        c, _, t, decoded, recoded = heapq.heappop(queue)
        if decoded and (best is None or c < best[0]):
            best, limit = (c, t), min(c, limit)
        if best is not None and best[0] <= least + 1e-9:
            # only a reading of two bytes a character, which joins runs, can still be cheaper
            wide = [(cost(u, limit), u) for _, _, x, _, done in [(c, 0, t, decoded, recoded), *queue] if not done for u in (_recode(x, *step) for step in WIDE) if u is not None]
            best = min([best, *wide], key=lambda x: x[0])
            break
        for u, d, r in _next(t, recoded):
            h = hash((u, r))
            if h in seen:
                continue
            seen.add(h)
            if r and not _ESCAPED.search(u) and not any(p.search(u) for p in UTF.values()):
                # nothing follows from it, so it counts at once and only if it is cheaper than what is known
                cu = cost(u, limit)
                if cu <= limit and (best is None or cu < best[0]):
                    best = (cu, u)
                    limit = cu
                continue
            heapq.heappush(queue, (cost(u), len(seen), u, decoded or d, r))
    if best is None:
        return text, False
    return (best[1], True) if best[0] <= reference - MARGIN else (text, False)


def restore(text: str) -> tuple[str, bool, bool]:
    """(restored text, garbled, lossy) of a whole text, line by line; inline code between backticks stays as it is.

    `lossy` tells that characters were lost (U+FFFD, or a first byte without its tail) and can't be had back; texts with
    U+FFFD count as garbled.
    """
    out, garbled, lossy = [], False, False
    for line in text.split("\n"):
        if not (_BEYOND.search(line) or _ESCAPED.search(line)):
            out.append(line)
            continue
        parts, at = [], 0
        for m in [*_QUOTED.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)]
            if _BEYOND.search(plain) or _ESCAPED.search(plain):
                fixed, changed = repair(plain)
                garbled |= changed
                lossy |= "\ufffd" in plain or (changed and bool(_LONELY.search(fixed)))
                plain = fixed
            parts.append(plain)
            if m:
                parts.append(m.group())
                at = m.end()
        out.append("".join(parts))
    return "\n".join(out), garbled or lossy, lossy


def find_garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, lossy) of the affected rows. NULL, empty and plain ASCII texts without escapes never leave the JVM.

    Every row is judged alone, so nothing is shuffled; repeated rows are reported as often as they occur; columns of any
    other name are ignored. Texts are whole, whatever their length.
    """
    src = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").rlike(SUSPECT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                fixed, garbled, lossy = restore(t)
                if garbled:
                    rows.append((d, fixed, lossy))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "lossy"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(run, f"doc_id {kind}, restored string, lossy boolean")
