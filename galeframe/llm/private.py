"""Personal data behind disguises, with its place in the source.

A text goes through transducers, each a list of edits (what was replaced, by what): look-alike characters, letters in
the place of digits, spelled digits, and words or brackets in the place of @ and the dot. Identifiers are then found in
what comes out, by the same patterns as in the text itself, and each span is led back through the edits to code points
of the source. A disguise is undone only where it can hide an identifier: a bare `at` needs a common top-level domain
behind it, and with it a disguised dot, capitals, or a name before it that is no plain word; a spelled digit needs a
neighbour. What the plain patterns find stays as it is; a disguised span is added if it has an edit in it, and if it
holds the plain spans of its kind that it touches.

A row needs nothing but itself: no shuffle, and a task holds one piece of a batch. Time and memory are linear in a
text's length, also for long runs of letters or digits.

Defined cases: a NULL text is empty and has no spans; equal rows have equal spans each; ties in the start go by kind
as in KINDS, then by end; an empty table stays empty; further columns stay, and those named like a result are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")

# plain patterns

LOCAL = "A-Za-z0-9._%+-"
LOCAL_CHARS = "".join(c for c in map(chr, range(128)) if re.match(f"[{LOCAL}]", c))
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
#: What a digit counts in every second place.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Does the checksum of card numbers hold?"""
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(DOUBLED[d] for d in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        before = text[done : m.start()]
        local = len(before) - len(before.rstrip(LOCAL_CHARS))
        if local:
            yield m.start() - local, m.end()
            done = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


# transducers


class Edits:
    """A rewritten text and the way back from its places."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, new text), in order, apart from each other."""
        out, self.at, self.to, self.until, self.was = [], [], [], [], []
        done = length = 0
        for a, b, new in edits:
            out += (text[done:a], new)
            length += a - done
            self.at.append(length)
            length += len(new)
            self.to.append(length)
            self.was.append(a)
            self.until.append(b)
            done = b
        out.append(text[done:])
        self.text = "".join(out)

    def start(self, p: int) -> int:
        k = bisect_right(self.at, p) - 1
        return p if k < 0 else self.was[k] if p < self.to[k] else p - self.to[k] + self.until[k]

    def end(self, p: int) -> int:
        k = bisect_right(self.at, p - 1) - 1
        return p if k < 0 else self.until[k] if p - 1 < self.to[k] else p - self.to[k] + self.until[k]


#: Letters of other scripts that look like a Latin letter or a digit, and the look-alike.
LOOKS = (
    "а a е e о o р p с c у y х x і i ј j ѕ s һ h ԁ d ԛ q ԝ w ӏ l к k т t м m н h в b п n г r ь b з 3 "
    "А A В B Е E К K М M Н H О O Р P С C Т T У Y Х X І I Ј J Ѕ S Ԍ G Ѵ V Ӏ I З 3 "
    "α a ο o ν v ρ p υ u ι i κ k τ t χ x γ y ε e η n ω w Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X "
    "ı i ɑ a ɡ g ɩ i ǀ l օ o հ h ո n ս u ց g 。 . · . • . ‧ . ∙ . ⋅ . ٫ . − - ➕ +"
).split()


def looks() -> dict[str, str]:
    """Character -> what it looks like in ASCII, or nothing for characters without width: compatibility forms, digits of all scripts, dashes, spaces, format characters, and LOOKS."""
    found = {}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F150), *range(0x1FBF0, 0x1FBFA)]:
        c = chr(code)
        kind, same = unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if kind == "Nd":
            found[c] = str(unicodedata.decimal(c))
        elif kind == "Pd":
            found[c] = "-"
        elif kind == "Zs":
            found[c] = " "
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0x334 <= code <= 0x338:
            found[c] = ""
        elif len(same) == 1 and same.isascii():
            found[c] = same
    return found | dict(zip(LOOKS[::2], LOOKS[1::2], strict=True))


LOOK = looks()

#: Letters that stand for a digit in a number.
AS_DIGIT = str.maketrans("OoIl|SBZ", "00111582")
DIGIT = re.compile("[0-9]")
DIGIT_LIKE = set("OoIl|SBZ")
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl|SBZ]{0,8}[0-9])[0-9]*+[OoIl|SBZ][0-9OoIl|SBZ]*+(?![A-Za-z])|(?<=[0-9]\.)[OoIl|]{1,3}(?![A-Za-z])")

#: Digits as words, from zero to nine, in English, Spanish, French and German.
SPELLED = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0", "nought": "0"}
SPELLED_WORD = re.compile(r"[^\W\d_]+")
#: Words that repeat the digit after them.
TIMES = {"double": 2, "triple": 3}
_UNIT = rf"(?:(?:{'|'.join(TIMES)})[ ]{{1,2}})?(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})|plus|dot|punto|point|punkt|[0-9]++|[\[(]\.[\])]|[\[(](?:dot|punto|point|punkt)[\])]"
NUMBER = re.compile(rf"(?i)(?<![^\W_])(?:{_UNIT})(?:[ ,/-]{{0,3}}(?<![^\W\d_](?=[^\W_]))(?:{_UNIT}))+(?![^\W_])")
UNIT = re.compile(rf"(?i){_UNIT}")

#: Top-level domains that a bare word may stand before.
TOP = set("com org net edu gov mil int info biz name dev app io ai co uk us ca au de fr es eu ch nl pl pt ru jp cn br mx ar cl se dk fi cz test example invalid local".split())
_OPEN, _CLOSE = r"[ ]{0,2}[\[({<][ ]{0,2}", r"[ ]{0,2}[\])}>][ ]{0,2}"
AT_MARK = rf"{_OPEN}(?:at|@|a|arroba|arobase|ät){_CLOSE}|[ ]?&(?:#64|#x40|commat);[ ]?|%40"
AT_BARE = r"[ _-](?:at|arroba|arobase|ät)[ _-]|[ ]{1,2}@[ ]{0,2}|@[ ]{1,2}"
DOT_MARK = rf"{_OPEN}(?:dot|\.|punto|point|punkt|period){_CLOSE}|[ ]?&(?:#46|#x2e|period);[ ]?|%2e"
DOT_BARE = r"[ _-](?:dot|punto|point|punkt)[ _-]|[ ]{1,2}\.[ ]{1,2}"
AT = re.compile(rf"(?i)(?P<mark>{AT_MARK})|(?P<bare>{AT_BARE})|@")
LABEL = re.compile(r"(?i)[a-z0-9]++(?:-++(?!(?:dot|punto|point|punkt)-)[a-z0-9]++)*+")
DOT = re.compile(rf"(?i)(?P<mark>{DOT_MARK})|(?P<bare>{DOT_BARE})|\.")
LOCAL_DOTS = re.compile(rf"(?i)[a-z0-9._%+]{{1,64}}(?:(?:{DOT_MARK}|[ _-]dot[ _-])[a-z0-9._%+]{{1,64}}){{1,4}}\Z")
#: A name that hardly is a word of a sentence: parts joined by a dot, hyphen or underscore, or two digits and more.
NAME = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)+\Z|(?<![A-Za-z0-9._%+-])[A-Za-z]*[0-9]{2,}\Z")
LOCAL_DOT = re.compile(rf"(?i){DOT_MARK}|[ _-]dot[ _-]")
DISGUISED_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{DOT_MARK}|{DOT_BARE})[0-9]{{1,3}}){{3}}(?![0-9])")
#: One of these, or a bracket before one, is in every text that has a disguised @ or dot.
HINTS = ("dot", "punkt", "punto", "point", "period", " @", "@ ", "&#", "%40", "%2e", "&commat", "arroba", "arobase")
AT_HINT = re.compile(r" at [a-z0-9-]+\.[a-z0-9]")
BRACKET_HINT = re.compile(r"[\[({<][ ]{0,2}[a@.ä]")


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    found = set() if text.isascii() else LOOK.keys() & set(text)
    if not found:
        return []
    return [(m.start(), m.end(), LOOK[m[0]]) for m in re.finditer(f"[{''.join(map(re.escape, sorted(found)))}]", text)]


def mixed_numbers(text: str) -> list[tuple[int, int, str]]:
    """Letters for digits, in numbers."""
    ends = [m.start() for m in DIGIT.finditer(text)]
    if not any(text[k - 1 : k] in DIGIT_LIKE or text[k + 1 : k + 2] in DIGIT_LIKE or text[k + 1 : k + 2] == "." and text[k + 2 : k + 3] in DIGIT_LIKE for k in ends):
        return []
    return [(m.start(), m.end(), m[0].translate(AS_DIGIT)) for m in MIXED.finditer(text)]


def has_spelled(text: str) -> bool:
    """Is one of the words a digit?"""
    for token in set(text.lower().split()):
        if token in SPELLED or not token.isalpha() and not SPELLED.keys().isdisjoint(SPELLED_WORD.findall(token)):
            return True
    return False


def spelled_numbers(text: str) -> list[tuple[int, int, str]]:
    """Runs of digits as words, signs and numbers become one number, if they hold two such words, or one and a dot."""
    if not has_spelled(text):
        return []
    out = []
    for m in NUMBER.finditer(text):
        new, words = [], 0
        for u in UNIT.findall(m[0]):
            *times, last = u.lower().split()
            if last in SPELLED:
                words += 1
                new.append(SPELLED[last] * TIMES.get(times[0] if times else "", 1))
            else:
                new.append(last if last.isdigit() else "+" if last == "plus" else ".")
        if words > 1 or words and "." in new:
            out.append((m.start(), m.end(), "".join(new)))
    return out


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Words and brackets for @ and dots, in e-mail and network addresses."""
    low = text.lower()
    if not any(h in low for h in HINTS) and not AT_HINT.search(low) and not (any(b in low for b in "[({<") and BRACKET_HINT.search(low)):
        return []
    out = [(m.start() + d.start(), m.start() + d.end(), ".") for m in DISGUISED_IP.finditer(text) for d in DOT.finditer(m[0]) if d[0] != "."]
    done = 0
    for at in AT.finditer(text):
        if at.start() <= done or text[at.start() - 1] not in LOCAL_CHARS:
            continue
        p, dots, good, disguised = at.end(), [], None, at.lastgroup is not None
        hidden = False
        while label := LABEL.match(text, p):
            if dots:
                hidden |= dots[-1].lastgroup is not None
                name = label[0].lower()
                strict = dots[-1].lastgroup == "bare" or at.lastgroup == "bare"
                if name in TOP if strict else len(name) > 1 and name.isalpha():
                    good = (list(dots), hidden)
            dot = DOT.match(text, label.end())
            if not dot:
                break
            dots.append(dot)
            p = dot.end()
        if not good or not (disguised or good[1]):
            continue
        if at.lastgroup == "bare" and "@" not in at[0] and not good[1] and "AT" not in at[0] and not NAME.search(text[max(done, at.start() - 65) : at.start()]):
            continue
        before = max(done, at.start() - 330)
        if local := LOCAL_DOTS.search(text[before : at.start()]):
            first = before + local.start()
            out += [(first + d.start(), first + d.end(), ".") for d in LOCAL_DOT.finditer(local[0])]
        if disguised:
            out.append((at.start(), at.end(), "@"))
        out += [(d.start(), d.end(), ".") for d in good[0] if d.lastgroup]
        done = good[0][-1].end()
    out.sort()
    return [e for k, e in enumerate(out) if not k or e[0] >= out[k - 1][1]]


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (look_alikes, mixed_numbers, spelled_numbers, addresses)


def spans(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, plain) of a text's identifiers; value is the identifier without its disguise."""
    base = plain(text)
    out = [(kind, a, b, text[a:b], True) for kind in KINDS for a, b in base[kind]]
    now, way = text, []
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            way.append(Edits(now, edits))
            now = way[-1].text
    if way:
        for kind, found in plain(now).items():
            own = base[kind]
            for p, q in found:
                a, b = p, q
                for e in reversed(way):
                    a, b = e.start(a), e.end(b)
                touched = own[bisect_right(own, a, key=lambda s: s[1]) :]
                touched = [s for k, s in enumerate(touched) if s[0] < b] if touched and touched[0][0] < b else []
                if text[a:b] != now[p:q] and (a, b) not in touched and all(a <= s[0] and s[1] <= b for s in touched):
                    out.append((kind, a, b, now[p:q], False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "struct<kind:string,start:int,end:int,value:string,plain:boolean>"


def find(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """The rows with an array of their spans: kind, start and end (code points, end exclusive), value without disguise, plain."""
    docs = docs.drop(name) if name in docs.columns else docs
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("plain", pa.bool_())]))
    fields = ("kind", "start", "end", "value", "plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                texts = piece.column(piece.schema.get_field_index(text_col)).to_pylist()
                got = pa.array([[dict(zip(fields, s, strict=True)) for s in spans(t or "")] for t in texts], kind)
                yield pa.RecordBatch.from_arrays([*piece.columns, got], [*piece.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{name}` array<{SPAN}>"]))


def told(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span of the text replaced by its kind in angle brackets; of spans that overlap, the first counts, and the longest of those that begin with it. NULL stays NULL."""
    first = F.array_sort(F.col("_spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.col(text_col)
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    put = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["done"], cut(s["at"], x["start"]), F.lit("<"), x["kind"], F.lit(">")).alias("done"), x["end"].alias("at")))
    whole = F.aggregate(first, start, put, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    return find(docs, text_col, "_spans").withColumn(text_col, F.when(text.isNotNull(), whole)).drop("_spans")
