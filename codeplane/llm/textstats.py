"""Figures of texts: words, symbols, line ends, common words, repetition, and the share of running sentences.

Texts are read a batch at a time.  Every token between blanks is judged once and remembered as a number;
what is said of lines, paragraphs and windows of tokens are sums over arrays of these numbers.
"""

from __future__ import annotations

import re
from itertools import chain

# The most common words that bind sentences, by language; they only give the figure common_share.
COMMON = {
    "en": frozenset(
        "the a an of to in and or is are was were be been being it its that this these those for on with as by at from not no but if then than so when while which who whom whose what how why there here "
        "have has had do does did will would can could should may might must shall before after because although since until unless once into onto over under between about again even only just very any "
        "some each every all both either neither more most many much few less such same other another own up down out off we you they he she i me us them him her my our your their his one".split()
    ),
    "de": frozenset(
        "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden wurde wurden sein hat haben hatte hatten nicht kein keine keinen auf in im an am zu zum zur von "
        "vom mit für bei nach vor aus über unter durch um ohne gegen als wie wenn dass daß weil da damit ob noch nur auch schon sehr mehr es er sie wir ich ihr man sich sein seine ihre dieser diese dieses "
        "jeder jede jedes einige alle davon dabei dann danach so bis während gibt sollte kann können muss müssen soll mal einmal wieder immer hier dort doch nun".split()
    ),
    "fr": frozenset(
        "le la les l un une des du de d et ou mais est sont était étaient été être a ont avait ont eu ne pas n plus que qu qui quoi dont où ce cet cette ces c il elle ils elles on nous vous je j tu se s sa son "
        "ses leur leurs notre nos votre au aux en dans sur sous avec sans pour par chez vers entre comme si quand lorsque parce car donc alors tout tous toute toutes chaque plusieurs aucun même aussi très "
        "bien encore y faut peut peuvent doit fait faire après avant pendant depuis jusqu ainsi mieux seule".split()
    ),
    "es": frozenset(
        "el la los las un una unos unas lo de del al y o u pero es son era eran fue fueron ser está están estaba ha han había haber no ni que quien cual cuyo donde cuando como si porque pues aunque mientras "
        "este esta estos estas ese esa esos esas esto eso se su sus le les me te nos mi tu nuestro en con sin por para sobre entre hasta desde hacia tras según a más menos muy ya también todo toda todos todas "
        "cada algún alguna algunos ninguno otro otra otros mismo sólo solo solamente antes después hay puede pueden debe hace hacer así vez".split()
    ),
}
LANGUAGES = tuple(COMMON)
#: Letters of a word that binds sentences, at most; in every language that writes blanks these are articles, pronouns, prepositions and particles for the most part.
SHORT = 3
#: Tokens on either side of a token that say whether it stands in a sentence, and the shares of clean and of short words they need.
REACH, CLEAN_NEEDED, SHORT_NEEDED = 6, 0.75, 0.16
#: A run of this many tokens that recurs so often, and once in so many tokens, is a phrase repeated over and over.
RUN, RECURS, WITHIN = 5, 4, 100
#: Tokens that a worker remembers, at most, and the longest of them.
REMEMBERED, LONGEST = 300_000, 32

_CLEAN = re.compile(r"[(\[\"'“„«‘’*_¿¡]*([^\W\d_]+)(?:[-'’/][^\W\d_]+)*[)\]\"'”“»’*_]*[.,;:!?…]*[)\"'”»]?$")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")
_ENDS = re.compile(r"[.!?;…。！？][)\"'”»*_]*$")
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = "()[]{}\"'“”„«»‘’*_¿¡.,;:!?…"
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_SYMBOLS, _DIGITS = b"=(){}[]<>|\\^~%$#@&*+/_\"", b"0123456789"
_BREAK = "\0"
# What a token's number holds: its length, the letters of its word, and these marks.
_IS_CLEAN, _IS_SHORT, _IS_WORD, _IS_END, _IS_BREAK, _COMMON = 1, 2, 4, 8, 16, 5
_LENGTH = _COMMON + len(LANGUAGES)


class _Codes(dict):
    """The number of a token; those of short tokens are kept, up to a bound."""

    def __missing__(self, token: str) -> int:
        code = _code(token)
        if len(self) < REMEMBERED and len(token) <= LONGEST:
            self[token] = code
        return code


def _code(token: str) -> int:
    if token == _BREAK:
        return _IS_BREAK
    code = 0
    if _LETTER.search(token):
        word = token.strip(_EDGES).lower()
        code |= _IS_WORD
        for i, l in enumerate(LANGUAGES):
            if word in COMMON[l]:
                code |= 1 << _COMMON + i
        if m := _CLEAN.match(token):
            code |= _IS_CLEAN | (_IS_SHORT if len(m[1]) <= SHORT else 0)
        elif not token.isascii() and _UNSPACED.search(token):
            code |= _IS_CLEAN | _IS_SHORT  # a script without blanks between words
    elif token.strip(_EDGES).isdigit():
        code |= _IS_CLEAN
    if _ENDS.search(token):
        code |= _IS_END
    return code | len(token) << _LENGTH


_number = _Codes().__getitem__


def _tokens(text: str) -> list[str]:
    """The tokens between blanks, with line ends among them; a span of code is one word."""
    if "`" in text:
        text = _CODE_SPAN.sub("code", text)
    return text.replace("\n", " \0 ").split() if "\n" in text else text.split()


def _recurring(tokens: list[str], sizes):
    """Whether each token is of a phrase that its text repeats over and over."""
    import numpy as np

    n = len(tokens)
    out = np.zeros(n, bool)
    if n < RUN:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    word = np.fromiter(map(hash, tokens), np.int64, n).view(np.uint64)
    key = owner[: n - RUN + 1].astype(np.uint64)
    for k in range(RUN):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : n - RUN + 1 + k]
    whole = np.flatnonzero(owner[: n - RUN + 1] == owner[RUN - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    if not len(order):
        return out
    first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    counts = np.diff(np.append(first, len(order)))
    often = order[np.repeat(counts, counts) >= np.maximum(RECURS, -(-sizes[owner[order]] // WITHIN))]
    for k in range(RUN):
        out[often + k] = True
    return out


class Batch:
    """The numbers of the tokens of some texts, one after the other, and where each text begins."""

    def __init__(self, texts: list[str | None]):
        import numpy as np

        split = [_tokens(t) if t else [] for t in texts]
        tokens = list(chain.from_iterable(split))
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.code = np.fromiter(map(_number, tokens), np.int64, len(tokens))
        self.recurs = _recurring(tokens, self.sizes)

    def per_text(self, values):
        """The sum of the values of every text."""
        import numpy as np

        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[self.begin + self.sizes] - sums[self.begin]

    def running(self):
        """Characters (white space aside) in running sentences, per text."""
        import numpy as np

        code, n = self.code, len(self.code)
        if not n:
            return np.zeros(len(self.sizes), np.int64)
        breaks = code & _IS_BREAK != 0
        # paragraphs end at blank lines and with the text
        first = np.zeros(n, bool)
        first[self.begin[self.sizes > 0]] = True
        first[1:] |= breaks[1:] & breaks[:-1]
        kept = np.flatnonzero(~breaks)
        if not len(kept):
            return np.zeros(len(self.sizes), np.int64)
        paragraph = np.cumsum(first)[kept]
        starts = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
        lengths = np.diff(np.append(starts, len(kept)))
        lo, hi = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        at = np.arange(len(kept))
        a, b = np.maximum(lo, at - REACH), np.minimum(hi, at + REACH + 1)
        c = code[kept]
        clean = (c & _IS_CLEAN != 0) & ~self.recurs[kept]

        def share(flags):
            sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return (sums[b] - sums[a]) / (b - a)

        inside = clean & (share(clean) >= CLEAN_NEEDED) & (share(c & _IS_SHORT != 0) >= SHORT_NEEDED)
        values = np.zeros(n, np.int64)
        values[kept] = np.where(inside, c >> _LENGTH, 0)
        return self.per_text(values)


#: Statistics of a text, in the order in which figures() returns them.
STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "short_share", "clean_share", "repeat_share", "mean_line_length", "running_share")


def figures(texts: list[str | None]) -> tuple[list[tuple], list[str]]:
    """The statistics of every text, and its language by common words ('' if none dominates); null and blank texts have zeros."""
    import numpy as np

    if not texts:
        return [], []
    x = Batch(texts)
    code = x.code
    size = np.maximum(x.per_text(code >> _LENGTH), 1)
    breaks = code & _IS_BREAK != 0
    words, tokens = x.per_text(code & _IS_WORD != 0), x.per_text(~breaks)
    # a line's last token stands before a break or at the text's end
    last = np.append(breaks[1:], True) if len(code) else breaks
    last[(x.begin + x.sizes - 1)[x.sizes > 0]] = True
    last &= ~breaks
    lines, ends = x.per_text(last), x.per_text(last & (code & _IS_END != 0))
    common = np.stack([x.per_text(code >> _COMMON + i & 1) for i in range(len(LANGUAGES))])
    best = common.argmax(axis=0)
    most = common.max(axis=0)
    symbols, digits, parts, distinct = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        if t:
            raw = t.encode("utf-8", "surrogatepass")
            symbols[i], digits[i] = len(raw) - len(raw.translate(None, _SYMBOLS)), len(raw) - len(raw.translate(None, _DIGITS))
            said = t.replace(". ", ".\n").split("\n")
            blank = said.count("")
            parts[i], distinct[i] = len(said) - blank, len(set(said)) - (blank > 0)
    of = lambda a, b: a / np.maximum(b, 1)
    columns = [
        np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)), words, of(x.per_text(np.where(code & _IS_WORD != 0, code >> _LENGTH, 0)), words), of(symbols, size), of(digits, size), of(ends, lines),
        of(most, words), of(x.per_text(code & _IS_SHORT != 0), tokens), of(x.per_text(code & _IS_CLEAN != 0), tokens), of(parts - distinct, parts), of(size, lines) * (lines > 0), of(x.running(), size),
    ]
    return list(zip(*(c.tolist() for c in columns))), [LANGUAGES[b] if m * 6 > w else "" for b, m, w in zip(best.tolist(), most.tolist(), words.tolist())]


def running_shares(texts: list[str | None]) -> list[float]:
    """The share of the characters (white space aside) that running sentences make up, per text.

    A token stands in a sentence if the tokens around it in its paragraph, whatever the line breaks, are clean words for the most
    part and enough of them short: words that bind sentences are short in any language, names and terms are not.
    Phrases that recur over and over don't count; a script without blanks between words counts as it is.
    """
    import numpy as np

    if not texts:
        return []
    x = Batch(texts)
    return (x.running() / np.maximum(x.per_text(x.code >> _LENGTH), 1)).tolist()


def running_share(text: str | None) -> float:
    return running_shares([text])[0]
