"""Pages of repeated keywords, links or product tags instead of sentences, told by the shapes of their lines.

Every line is reduced to a shape: the numbers of its words, capitals, separators and links on a coarse scale. No words of any
language and no field names are known; a line is a list of links, tags or prices by its numbers. Plain lines are grouped by
shape (each long line, blocks of short ones), and a group is a keyword run if it keeps saying the same long words, or few others, in short pieces that
aren't told in sentences. A page is found if few such shapes hold more than half of its characters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page's characters above which it is found, and how many shapes at most may make it up.
MOST, FEW = 0.5, 12
#: A line of so many words is judged alone, shorter ones with their neighbours. A group of fewer words than LEAST is judged with all such groups.
LONG, LEAST = 20, 8
#: Novelty is the share of letters in words not said before within so many words. Below SAME a group says the same again.
WINDOW, SAME = 40, 0.5
#: In pieces of up to SHORT words between separators, a group below ALIKE is a run too, or one with a share ODD of disguised words.
SHORT, ALIKE, ODD = 3.6, 0.62, 0.15
#: The share of a line's words told in sentences from which it is no run, and of a group's from which one above SAME is none. A sentence has so many words, and so many for each piece.
TOLD, PARTLY, SENTENCE, PIECE = 0.5, 0.25, 5, 2.5
#: Beside links, tags and products of so large a share of a page, pieces of up to so many words outside of sentences belong to them.
BESIDE, LABEL_WORDS = 0.25, 5
MATTER = ("links", "products", "tags", "keywords")

_DOT = r"(?:\s\.\s|\[\.\]|\(\.\)|\sdot\s|\.)"
_ADDRESS = rf"(?:h(?:tt|xx)ps?://|www\s?\.\s?|visit\s+)[\w-]+(?:{_DOT}[\w-]+)+(?:[/?][^\s\]|<>)}}\"]*)?"
LINK = re.compile(
    r"<a\s[^<>]*>[^<]*</a>"
    r"|\{\{\s*\w+\s*\|\s*(?:1=|url=)?\s*h(?:tt|xx)ps?:[^{}]*\}\}"
    r"|\[\[[^\[\]]*\]\]"
    r"|\[[^\[\]\n]*\]\(\s*h(?:tt|xx)ps?:[^()\s]*\)"
    rf"|\[\s*{_ADDRESS}[^\[\]\n]*\]|{_ADDRESS}",
    re.I,
)
#: A line without any of these holds no link.
HINT = re.compile(r"[\[{<]|://|[wW]{3}|isit |ISIT ")
REFERENCE = re.compile(r"<ref[^<>]*/>|<ref[^<>]*>(?:(?!</?ref)[\s\S])*</ref>|\{\{cite[^{}]*\}\}", re.I)
#: A link to another kind of page: a file, a category, an account.
ELSEWHERE = re.compile(r"\[\[\s*:?\w[\w ]{0,40}:(?!//)")
LABEL = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
#: Headings, templates and tables.
LAYOUT = re.compile(r"\s*(?:\{\||\|\}|\|-|\||!|\{\{|\}\}|=+[^=])")
CELLS = re.compile(r"\t[^\t\d]*\d")
PRICE = re.compile(r"[$¢-¥₠-₿]\s?\d|\d\s?[$¢-¥₠-₿]")
TAG = re.compile(r"#[^\W_#][^\s#,;|]*|#-[^\s#]*")
#: Words written with a dot after every letter.
DOTTED = re.compile(r"(?<![^\W_])(?:[^\W_]\.[ .]{0,3}){2,}[^\W_](?![^\W_])\.?")
SEPARATOR = re.compile(r"(?=[,;|/•·★✔►:،、»\s<.!?؟。])(?:(?:[,;|/•·★✔►:،、]|(?<=\s)»|\s[-–](?=\s)|<br>|(?<![.!?])[.!?؟]++(?=[\s,;\"”»')\]]|$)|。)\s*)+")
END = re.compile(r"(?<![.!?])[.!?؟]++[\"”»')\]]*(?=\s|$)|。")
#: Letters and digits in one word, as in disguised ones.
MIXED = re.compile(r"[A-Za-z]\d|\d[A-Za-z]")
#: Scripts that set no spaces between words: two letters count as a word.
UNSPACED = re.compile("[฀-໿぀-ヿ㐀-鿿]")
#: Cyrillic letters that look like Latin ones; fixed values.
ALIKE_LETTERS = str.maketrans("аеорсухіѕјһԁАВЕКМНОРСТХІЅЈ", "aeopcyxisjhdABEKMHOPCTXISJ")
CYRILLIC = re.compile("[Ѐ-ԯ]")
#: UTF-8 read as a one-byte encoding: lead bytes, each with a trail byte.
BROKEN = re.compile("[ÂÃÐÑØÙÚÛã-ï][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™\ufffd]")
DIGITS_AS_LETTERS = str.maketrans("013457", "oieast")


_first = itemgetter(0)


def _byte(char: str) -> bytes:
    try:
        return char.encode("cp1252")
    except UnicodeEncodeError:
        return bytes([ord(char)]) if ord(char) < 256 else b"\xff"


def _plain(line: str) -> str:
    """Broken encodings mended as far as they can be, compatibility forms and look-alikes as ordinary letters, and words written with dots as words."""
    if not line.isascii():
        if 8 * len(BROKEN.findall(line)) > len(line):
            line = b"".join(map(_byte, line)).decode("utf-8", "replace")
        line = unicodedata.normalize("NFKC", line)
        other = set(CYRILLIC.findall(line))
        if other and all(ord(c) in ALIKE_LETTERS for c in other):
            line = line.translate(ALIKE_LETTERS)
    if line.count(".") < 2:
        return line
    return DOTTED.sub(lambda m: re.sub(r"\.(?! )|\. ?$", "", m.group().replace(". .", " ").replace(".", "")), line)


def _size(words: list[str], text: str) -> int:
    return len(words) if text.isascii() else len(words) + len(UNSPACED.findall(text)) // 2


def _told(text: str, separators: list[int]) -> int:
    """Words in sentences: pieces up to a full stop that are long, not chopped by separators, and don't repeat themselves."""
    at = total = 0
    for end in END.finditer(text):
        piece = text[at : end.start()]
        words = piece.split()
        if len(words) == SENTENCE - 1:
            words = WORD.findall(piece)
        n = _size(words, piece)
        if n >= SENTENCE and len(set(words)) >= 0.7 * len(words) and n >= PIECE * (bisect_left(separators, end.start()) - bisect_left(separators, at) + 1):
            total += n
        at = end.end()
    return total


def _bytes(word: str) -> int:
    return len(word.encode("utf-8", "surrogatepass"))


def _novelty(words: list[str]) -> float:
    """The share of letters in words not said before, averaged over windows of WINDOW words; letters count as bytes, as those of unspaced scripts say more."""
    new = all_ = 0
    for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW):
        part = words[max(0, min(i, len(words) - WINDOW)) :][:WINDOW]
        new += sum(map(_bytes, set(part)))
        all_ += sum(map(_bytes, part))
    return new / max(1, all_)


def _scale(n: int) -> int:
    """0, 1, 2 and then the powers of 4 below ``n``."""
    return n if n < 3 else 1 << ((n.bit_length() - 1) & ~1)


class Shape(NamedTuple):
    words: int
    capitals: int
    separators: int
    links: int

    @classmethod
    def of(cls, words: int, capitals: int, separators: int, links: int) -> Shape:
        return cls(*map(_scale, (words, capitals, separators, links)))


class _Plain(NamedTuple):
    """A line that its own numbers don't settle."""

    shape: Shape
    chars: int
    words: list
    size: int
    pieces: int
    odd: int
    told: int


class _Block(NamedTuple):
    """Lines judged together, and the short told line before them."""

    lines: list
    before: _Plain | None

    def size(self) -> int:
        return sum(x.size for x in self.lines)


def page_shapes(text: str | None) -> tuple[dict[tuple[str, Shape], list[int]], int]:
    """The (kind, shape) of a text's lines with their numbers of lines and characters, and the characters of the page."""
    text = html.unescape(text or "")
    page = len(text.strip()) + 1
    if "<" in text or "{{" in text:
        text = REFERENCE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    found: dict[tuple[str, Shape], list[int]] = defaultdict(lambda: [0, 0])
    blocks: list[_Block] = [_Block([], None)]  # of short lines each block that no told line divides, and each long line
    entries: list[int] = []

    def add(kind: str, shape: Shape, chars: int) -> None:
        entry = found[kind, shape]
        entry[0] += 1
        entry[1] += chars

    for given in text.split("\n"):
        if not given.strip():
            continue
        line, chars = _plain(given), len(given) + 1
        rest, links = LINK.subn(" ", line) if HINT.search(line) else (line, 0)
        words = WORD.findall(rest)
        if links and not ELSEWHERE.search(line):
            if links == 1 and "[[" in line:
                if not words:  # a heading of items below it, or one of a list of links
                    entries.append(chars)
                    continue
            elif len(words) <= links:
                add("links", Shape.of(len(words), 0, 0, links), chars)
                continue
        if links:
            rest = LINK.sub(" ", LABEL.sub(r"\1", line))
            words = words if len(words) >= 3 else WORD.findall(rest)  # of an entry that says something, what it says
        if LAYOUT.match(line) or "||" in line or ("\t" in line and CELLS.search(line)):
            add("layout", Shape.of(len(words), 0, 0, links), chars)
            continue
        separators = [m.start() for m in SEPARATOR.finditer(rest)]
        size = _size(words, rest)
        shape = Shape.of(len(words), sum(map(str.isupper, map(_first, words))), len(separators), links)
        told = _told(rest, separators) if size >= SENTENCE else 0
        if line.count("|") + line.count(";") >= 2 and PRICE.search(line) and len(words) <= 5 * (len(separators) + 1):
            add("products", shape, chars)
            continue
        if "#" in line and sum(map(len, TAG.findall(line))) > 0.7 * len(line.strip()):
            add("tags", shape, chars)
            continue
        if told >= TOLD * max(size, 1):
            add("text", shape, chars)
            blocks.append(_Block([], _Plain(shape, chars, words, size, len(separators) + 1, 0, told) if size < LONG else None))
            continue
        odd = 0
        if MIXED.search(rest):
            odd = sum(1 for w in words if MIXED.search(w))
            words = [w.translate(DIGITS_AS_LETTERS) if MIXED.search(w) else w for w in words]
        if given.count(".") > 4:
            odd += len(DOTTED.findall(given))
        own = _Plain(shape, chars, words, size, len(separators) + (1 if words else 0), odd, told)
        if size < LONG:
            blocks[-1].lines.append(own)
        else:
            blocks += [_Block([own], None), _Block([], None)]
    for chars in entries:
        add("links" if len(entries) > 2 else "layout", Shape(0, 0, 0, 1), chars)
    beside = sum(n for (kind, _), (_, n) in found.items() if kind in MATTER) > BESIDE * page
    said = Counter(tuple(x.words) for b in blocks for x in b.lines)
    large = [b for b in blocks if b.size() >= LEAST]
    for block in [*large, _Block([x for b in blocks if b.size() < LEAST for x in b.lines], None)]:
        repeats = any(said[tuple(x.words)] > 1 for x in block.lines)
        with_before = block.before is not None and repeats and not beside and block.size() <= 2 * block.before.size  # a refrain after its verse
        run = _is_run(block.lines, beside) and (not with_before or _is_run([block.before, *block.lines], beside))
        for x in block.lines:
            add("keywords" if run else "text", x.shape, x.chars)
    return dict(found), page


def _is_run(group: list[_Plain], beside: bool) -> bool:
    n = sum(x.size for x in group)
    if n < LEAST and not beside:
        return False
    told = sum(x.told for x in group) / max(1, n)
    words = [w.lower() for x in group for w in x.words]
    novelty, piece = _novelty(words), n / max(1, sum(x.pieces for x in group))
    if novelty < SAME or (beside and piece <= LABEL_WORDS and told < PARTLY / 2):
        return True
    return piece <= SHORT and told < PARTLY and (novelty < ALIKE or sum(x.odd for x in group) > ODD * len(words))


def is_stuffed(text: str | None) -> bool:
    """Whether the few most used shapes of links, products, tags and keyword runs hold more than half of the page."""
    shapes, page = page_shapes(text)
    matter = sorted((n for (kind, _), (_, n) in shapes.items() if kind in MATTER), reverse=True)
    return sum(matter[:FEW]) > MOST * page


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [i for i, text in enumerate(batch.column(1)) if is_stuffed(text.as_py())]
        if found:
            yield batch.select(["doc_id"]).take(pa.array(found))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the pages more than half of whose characters are links, products, tags or keyword runs in few shapes.

    Each row is a page and is judged alone, so copies of a page are all found and rows that share a doc_id don't add up; an id
    comes out once. Empty, blank and null texts have no shapes, and a null doc_id is never found. Only found ids are shuffled.
    """
    return documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_judge, "doc_id bigint").distinct()


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(kind, *shape, *counts) for text in batch.column(0) for (kind, shape), counts in page_shapes(text.as_py())[0].items()]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=["kind", "words", "capitals", "separators", "links", "lines", "chars"])


def common_shapes(documents: DataFrame) -> DataFrame:
    """Of each kind and shape the pages, lines and characters that have it; counts are merged map-side."""
    rows = documents.select("text").mapInArrow(_reduce, "kind string, words bigint, capitals bigint, separators bigint, links bigint, lines bigint, chars bigint")
    return rows.groupBy("kind", "words", "capitals", "separators", "links").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("lines").alias("n_lines"), F.sum("chars").alias("n_chars"))
