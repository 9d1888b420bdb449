"""Structural features of lines, vectorised over blocks of documents.

Lines longer than SPAN characters are wrapped, so that a page written as one line still gives a sequence. A word is a
run of letters; how often it occurs in its own document is counted from hashed words, so nothing depends on language.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

SPAN = 240
#: Words added to a document's length where its words' shares are taken, so that short pages don't look repetitive.
DAMP = 80
(OTHER, LETTER, DIGIT, SPACE, BREAK, COMMA, PIPE, HASH, SLASH, COLON, STOP, CODE, QUOTE, LOW, DROP, BRACKET) = range(16)

#: A JSON string, whether it is a key, and a last one that was cut off.
_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)(?:"(\s*:)?|\Z)', re.S)
_CELLS = re.compile(r'"cells"\s*:\s*\[')
#: Fields of the notebook format that hold one word of its own instead of text.
_FORMAT = {"cell_type", "output_type", "kernel", "name", "mimetype", "language", "file_extension"}
_WORD = re.compile(r"[\w.+/-]{0,40}\Z")


def _class_table() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    table = np.full(0x110000, OTHER, np.uint8)
    by = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE}
    for c in range(0x30000):
        cat = unicodedata.category(chr(c))
        table[c] = DROP if cat == "Cf" else by.get(cat[0], OTHER)
    for chars, k in (("\n\r\x0b\x0c\x85  ", BREAK), ("\t", SPACE), (",;，；", COMMA), ("|·•・›»／", PIPE), ("#", HASH), ("/\\", SLASH), (":", COLON), (".!?。！？", STOP), ("=<>*+%^&~@$", CODE), ("\"'`", QUOTE), ("_-", LOW), ("()[]{}", BRACKET)):
        for c in chars:
            table[ord(c)] = k
    return table


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return _TABLE[0]


def plain(text: str) -> str:
    """All texts of a notebook's JSON in document order, whatever field they stand in (sources and outputs as one string or
    as lists, cut-off notebooks too); any other text as it is. Of the JSON only signs, keys, numbers and the format's own
    single words (FORMAT) are left out."""
    if not text.lstrip("\ufeff \t\r\n").startswith("{") or not _CELLS.search(text):
        return text
    found, key = [], ""
    for m in _STRING.finditer(text):
        if m[2]:
            key = m[1]
        elif key not in _FORMAT or not _WORD.match(m[1]):
            found.append(m[1])
    return "\n".join(_decoded(found))


def _decoded(strings: list[str]) -> list[str]:
    """JSON strings without their escapes; those whose escapes are broken lose none of their characters."""
    try:
        return [json.loads('"' + "\\n".join(strings) + '"', strict=False)]
    except ValueError:
        out = []
        for s in strings:
            try:
                out.append(json.loads(f'"{s}"', strict=False))
            except ValueError:
                out.append(s.replace("\\n", "\n"))
        return out


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(max(n, 1 << 20), base)
    return _POWERS[base][:n]


FEATURES = [
    "chars", "words", "letters", "digits", "seps", "bars", "tags", "links", "marks", "in_links", "out_words", "out_digits", "stops", "code", "quotes", "brackets", "tokens", "repeat", "often", "alike",
]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each line, FEATURES of each line) of the lines that hold anything but space.

    repeat and often: mean over the line's words of log2 of the word's count in its document, and of its (damped) share
    of the document's words. alike: how many whole lines of the document have the same words. in_links: characters of
    blank-free runs holding `//`; out_words, out_digits: words and digits outside them.
    """
    texts = [plain(t) for t in texts]
    big = "\n".join(texts) + "\n"
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    doc_at = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    k = classes()[codes]
    keep = k != DROP
    if not keep.all():
        codes, k, doc_at = codes[keep], k[keep], doc_at[keep]
    n = len(k)
    brk = k == BREAK
    line_start = np.flatnonzero(np.concatenate([[True], brk[:-1]]))
    line = np.cumsum(np.concatenate([[0], brk[:-1].astype(np.int64)]))
    offset = np.arange(n) - line_start[line]
    seg_start = np.flatnonzero((offset % SPAN) == 0)
    m = len(seg_start)
    seg_of = np.zeros(n, np.int64)
    seg_of[seg_start[1:]] = 1
    seg_of = np.cumsum(seg_of)

    def add(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), seg_start)

    def then(mask: np.ndarray, by: int = 1) -> np.ndarray:
        out = np.zeros(n, bool)
        out[:-by] = mask[by:]
        return out

    def past(mask: np.ndarray) -> np.ndarray:
        out = np.ones(n, bool)
        out[1:] = mask[:-1]
        return out

    letter, digit, space = k == LETTER, k == DIGIT, (k == SPACE) | brk
    slash = k == SLASH
    spaced = past(space) & then(space)
    token_begin = ~space & past(space)
    token = np.cumsum(token_begin)
    # `//` inside a run of letters or digits (encoded data) begins no address
    link = slash & then(slash) & then(letter, 2) & past(~(letter | digit | slash | (k == CODE)))
    linked = np.zeros(int(token[-1]) + 1 if n else 1, bool)
    linked[token[link]] = True
    linked[0] = False
    in_link = linked[token] & ~space
    word_begin = letter & ~past(letter)
    word_begin[0] = letter[0]
    begin = np.flatnonzero(word_begin)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    end = np.flatnonzero(last)
    seg = seg_of[begin]
    words = np.bincount(seg, minlength=m)
    with np.errstate(over="ignore"):
        low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
        run = np.cumsum(np.where(letter, low, 0).astype(np.uint64) * powers(n, _BASE))
        before = np.where(begin > 0, run[begin - 1], np.uint64(0))
        h = (run[end] - before) * powers(n, _INVERSE)[begin]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        in_doc = h + doc_at[begin].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    _, inverse, count = np.unique(in_doc, return_inverse=True, return_counts=True)
    c = count[inverse].astype(float)
    of_doc = np.bincount(doc_at[begin], minlength=len(texts)).astype(float)[doc_at[begin]]
    some = np.maximum(1, words)
    repeat = np.bincount(seg, np.log2(c), m) / some
    often = np.bincount(seg, (c - 1) / (of_doc + DAMP), m) / some
    # lines with the same bag of words in one document
    first_word = np.searchsorted(begin, seg_start)
    last_word = np.concatenate([first_word[1:], [len(begin)]])
    with np.errstate(over="ignore"):
        bag = (upto[last_word] - upto[first_word]) + doc_at[seg_start].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    head = offset[seg_start] == 0
    _, inverse, count = np.unique(bag[head], return_inverse=True, return_counts=True)
    alike = np.ones(m)
    alike[head] = count[inverse]
    chars = add(~space)
    cols = [
        chars, words, add(letter), add(digit), add(((k == COMMA) & (then(space) | then(k == QUOTE) | then(letter))) | (slash & spaced)), add((k == PIPE) & spaced),
        add((k == HASH) & then(letter) & past(space)), add(link), add((codes == ord("]")) & (then(codes == ord("(")) | then(k == COLON))), add(in_link),
        np.bincount(seg, ~in_link[begin], m), add(digit & ~in_link), add((k == STOP) & (then(space) | (codes > 0x2FFF))), add((k == CODE) | (k == LOW)), add(k == QUOTE), add(k == BRACKET), add(token_begin), repeat, often, alike,
    ]
    out = np.column_stack([np.asarray(x, float) for x in cols])
    kept = chars > 0
    return doc_at[seg_start][kept], out[kept]
