"""Personal data in texts: base patterns, and a character tagger for forms that these lack.

The tagger (tagger.py) is trained on labelled spans: sentences made from a fixed seed, with e-mail
addresses, IP addresses, card and phone numbers in many forms, and with dates, prices, versions,
hexadecimal strings, other numbers and prose that are none. It reads every text whole, in overlapping
windows that are decoded together. What it finds is kept if its odds are high, if it's well formed, if it's
no part of a longer word or number, and if no base span meets it.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tagger import CLASSES, KINDS, Tagger, classes

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A part that ends at no dot can't begin later in the same digits either.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
#: The tagger's spans need such mean odds.
ODDS = 0.5
#: Characters of texts that the tagger is given at once (a longer text by itself), and of a training window.
SLICE_CHARS, TRAIN_CHARS = 1_000_000, 96
AT = r"(?:\s?[(\[{<]\s?(?:@|at|AT)\s?[)\]}>]\s?|\s?@\s?)"
DOT = r"(?:\.|\s?[(\[{<]\s?(?:\.|dot|DOT)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)"
#: A bare "at" makes an address only with a "dot" that's spelled as well.
FORMS = [
    re.compile(rf"[\w.%+-]+(?:{AT}[\w-]+(?:{DOT}[\w-]+)+|\s(?:at|AT)\s[\w-]+(?:(?!\.){DOT}[\w-]+)+)"),
    re.compile(rf"[0-9]{{1,3}}(?:(?:{DOT}|\s?[-.,_:]\s?)[0-9]{{1,3}}){{3}}"),
    re.compile(r"[0-9](?:[ ./_·-]{0,3}[0-9])+"),
    re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9])+"),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ DOMAIN, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) by kind, then begin; code points, end exclusive."""
    if not TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def well_formed(kind: int, s: str) -> bool:
    """Whether a tagged string can be of its kind."""
    if not FORMS[kind].fullmatch(s):
        return False
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15 and bool(re.search(r"[ ().\-/]", s))


#: Forms of spans: # is a digit; at and dot signs go together. Those to train on, and others that tests hold out.
PHONES = ["(###) ###-####", "###-###-####", "### ### ####", "00## ### ######", "###.###.####", "0### ######", "0## #### ####", "(0##) ### ## ##", "## ## ## ## ##", "0###/######", "###-####-####", "0##.####.####", "(###)###.####", "00## ## ### ## ##", "0##-#######", "###/###.####", "####/######", "###/### ####", "### ###.####", "0### ###-###", "1-###-###-####"]
HELD_PHONES = ["(###)###-####", "### ###-####", "00## ## #######", "0#### #####", "(0##) #######", "###/###-####", "0##/### ## ##"]
IPS, HELD_IPS = ["[.]", " . ", "(.)", " dot ", "-", " [.] ", "[dot]", " (dot) ", " .", "{.}", " - ", "{dot}", " DOT "], [" [dot] ", "(dot)", " (.) ", ". "]
HELD_CARDS = [" · ", "/ ", "_ "]
CARDS = [x for c in "./_·-" for x in (c, c, f" {c} ", f"{c} ") if x not in HELD_CARDS and x != "-"]
AT_SIGNS = [" @ ", "(@)", " [@] ", " at ", " (at) ", " [at] ", " AT ", "(at)", "[at]", "@"]
DOT_SIGNS = [".", " dot ", " [dot] ", "(dot)", " DOT ", "[dot]", "."]
#: What the base patterns find, or what prose may be.
SKIPPED_MAILS = [("@", "."), (" at ", "."), (" AT ", ".")]
HELD_MAILS = [(" [at] ", "."), (" (at) ", "(dot)"), ("[at]", "[dot]"), ("(at)", " dot "), (" (@) ", ".")]


def labelled(n: int, seed: int, held_out: bool = False) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n sentences with their (kind, begin, end) spans, the same for the same seed.

    held_out: spans in the HELD_ forms, words of other syllables and other numbers about.
    """
    r = random.Random(seed)
    bits = ("ka lo mi ne sur tag wol pre fix est ind uro van del mer rin" if held_out else "the and er on in th en an re ti ou ea st nt ha es or nd le que de la einer sch un ber ción mi").split()
    phones, ips, cards = (HELD_PHONES, HELD_IPS, HELD_CARDS) if held_out else (PHONES, IPS, CARDS)
    mails = HELD_MAILS if held_out else [x for a in AT_SIGNS for d in DOT_SIGNS if (x := (a, d)) not in HELD_MAILS and x not in SKIPPED_MAILS]

    def word() -> str:
        if not held_out and r.random() < 0.4:
            return "".join(r.choices("abcdefghijklmnopqrstuvwxyzéèüñ", k=r.randint(2, 9)))
        return "".join(r.choices(bits, k=r.randint(1, 3)))

    def number(k: int) -> str:
        return "".join(r.choices("0123456789", k=k))

    def card() -> str:
        k = r.choice([13, 15, 16, 16, 16, 19])
        head = r.choice("3456") + number(k - 2)
        digits = head + next(d for d in "0123456789" if luhn(head + d))
        ends = {13: [4, 7, 10, 13], 15: [4, 10, 15], 16: [4, 8, 12, 16], 19: [4, 8, 12, 16, 19]}[k]
        groups = [digits[a:b] for a, b in zip([0, *ends], ends)]
        return r.choice(cards).join(groups)

    def phone() -> str:
        return "".join(number(1) if c == "#" else c for c in r.choice(phones))

    def email() -> str:
        name = r.choice([word(), f"{word()}.{number(2)}", f"{word()}.{word()}", f"{word()}_{word()}", word() + number(1)])
        host = [word() + r.choice(["", "", number(1)]), *([word()] if r.random() < 0.4 else []), r.choice(["io", "eu", "info"] if held_out else ["com", "org", "net", "de", "fr", "co", "ch", "edu", word()[:4]])]
        at, dot = r.choice(mails)
        return name + at + dot.join(host)

    def ip() -> str:
        return r.choice(ips).join(str(r.choice([r.randint(0, 255), r.randint(0, 255), 10, 192, 0])) for _ in range(4))

    def plain() -> tuple[int, str]:
        """Spans that the base patterns find as well."""
        return r.choice([lambda: (0, f"{word()}@{word()}.com"), lambda: (1, ".".join(str(r.randint(0, 255)) for _ in range(4))), lambda: (3, f"+{number(2)} {number(3)} {number(6)}")])()

    def other() -> str:
        return r.choice(
            [
                lambda: number(r.randint(1, 7)),
                lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}",
                lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}",
                lambda: f"{r.randint(0, 23)}:{number(2)}:{number(2)}",
                lambda: f"${number(2)}.{number(2)}",
                lambda: f"v{number(1)}.{number(1)}.{number(2)}",
                lambda: f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"',
                lambda: "".join(r.choices("0123456789abcdef", k=r.randint(6, 24))),
                lambda: number(r.randint(8, 24)),
                lambda: f"{number(3)} {number(3)}",
                lambda: f"#{number(4)} @{word()}",
                lambda: f"{number(1)},{number(3)},{number(3)}",
                lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
                lambda: ", ".join(number(r.randint(1, 3)) for _ in range(r.randint(2, 6))),
                lambda: " ".join(number(r.randint(1, 2)) for _ in range(r.randint(2, 4))),
                lambda: f"{number(2)}.{number(4)}, {number(2)}.{number(4)}",
                lambda: f"| {number(2)} | {number(3)} | {number(1)} |",
                lambda: f"{word()} at {number(r.randint(1, 4))}",
                lambda: f"{word()} at {word()}. {word()} dot {word()}",
                lambda: f"at {word()} {word()} dot",
                lambda: f"{word()} at {word()}.com",
                lambda: f"{word()} at {word()}.{word()}",
                lambda: f"({number(r.randint(1, 4))}) {word()}",
            ]
        )()

    out = []
    for _ in range(n):
        text, spans, after = "", [], False
        while len(text) < TRAIN_CHARS:
            roll = r.random() * (0.65 if after else 1)  # mostly a word after a span
            after = False
            if roll < 0.6:
                text += r.choice([word(), word(), word().capitalize(), word().upper()])
            elif roll < 0.76:
                text += other()
                after = r.random() < 0.7
            else:
                kind, value = plain() if roll > 0.97 else (k := r.randrange(4), (email, ip, card, phone)[k]())
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
                after = True
            text += r.choice([" ", " ", " ", " ", ", ", ". ", ": ", "\n", "*** ", "$$$ ", "; ", ") ", " | "])
        out.append((text, spans))
    return out


def arrays(sentences: list[tuple[str, list[tuple[int, int, int]]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of the sentences' first ``size`` characters."""
    ids, tags = np.full((len(sentences), size), CLASSES - 1), np.zeros((len(sentences), size), np.int64)
    for i, (text, spans) in enumerate(sentences):
        own = classes(text)[:size]
        ids[i, : len(own)] = own
        for kind, a, b in spans:
            tags[i, a:b] = 2 + 2 * kind
            if a < size:
                tags[i, a] = 1 + 2 * kind
    return ids, tags


@lru_cache(maxsize=2)
def trained(sentences: int = 6000, steps: int = 900, seed: int = 6) -> dict[str, np.ndarray]:
    """Weights of a tagger trained on labelled(sentences, seed); a session trains once."""
    tagger = Tagger()
    tagger.fit(*arrays(labelled(sentences, seed), TRAIN_CHARS), steps=steps)
    return tagger.w


def _signs(ids: np.ndarray) -> np.ndarray:
    """Of a text's classes: digits, @, and the t of an "at" that no letter stands before or after: every well-formed span has one."""
    t = (ids == ord("t")) | (ids == ord("T"))
    letter = ((ids >= 65) & (ids <= 90)) | ((ids >= 97) & (ids <= 122))
    a = ((ids == ord("a")) | (ids == ord("A"))) & ~np.concatenate([[False], letter[:-1]])
    return ((ids >= 48) & (ids <= 57)) | (ids == ord("@")) | (t & np.concatenate([[False], a[:-1]]) & ~np.concatenate([letter[1:], [False]]))


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """spans less those that an earlier one meets."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: s[1]):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def _edges(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged span moved out to the ends of words and numbers, and in over signs that no span begins or ends with."""
    while a < b and not (text[a].isalnum() or kind == 3 and text[a] in "(+"):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    signs = "._%+-" if kind == 0 else ""
    while a < b and a and (text[a - 1].isalnum() or text[a - 1] in signs):
        a -= 1
    while a < b < len(text) and text[b].isalnum():
        b += 1
    if kind == 3 and a and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    return a, b


#: Digit groups beside a span that a card may go on into.
_MORE, _LESS = re.compile(r"[ ./_·-]{1,3}[0-9]+"), re.compile(r"[0-9]+[ ./_·-]{1,3}\Z")


def _card_around(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The longest card that a span of digits makes with up to three digit groups on either side."""
    begins, ends = [a], [b]
    while len(begins) < 4 and (m := _LESS.search(text, max(0, begins[-1] - 24), begins[-1])):
        begins.append(m.start())
    while len(ends) < 4 and (m := _MORE.match(text, ends[-1], ends[-1] + 24)):
        ends.append(m.end())
    fit = [(x, y) for x in begins for y in ends if not text[x - 1 : x].isalnum() and not text[y : y + 1].isalnum() and well_formed(2, text[x:y])]
    return max(fit, key=lambda s: (s[1] - s[0], -s[0]), default=None)


#: What is read before a number that says it's none of these.
_NAMED = re.compile(r"(?:ISBN|ISSN|IBAN|EAN|SKU|DOI|[Oo]rder|[Ii]nvoice|[Tt]icket|[Aa]rticle|[Ii]tem|[Pp]art|[Ss]erial)(?:-1[03])?(?: ?(?:[Nn]o|[Nn]umber|[Nn]r|id|ID)\b)?[ .:#]*\Z|[A-Z]{2}[0-9]{2}(?: [0-9]{4})* \Z")
#: Runs of small numbers, and two groups of a year and a serial.
_ROW = re.compile(r"[0-9]{1,2}(?: [0-9]{1,2}){5,}|(?:19|20)[0-9]{2}(?:-[0-9]{4}){2}")


def _other_number(text: str, a: int, b: int) -> bool:
    """Whether a phone's digits are a row of numbers, an order's, or what the word before them names."""
    s = text[a:b]
    row = _ROW.fullmatch(s)
    rising = row and " " in s and (n := [int(x) for x in s.split()]) == sorted(n) and len(set(n)) == len(n)
    return bool(rising or row and "-" in s or _NAMED.search(text, max(0, a - 40), a))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger, least: float = ODDS) -> list[list[tuple[int, int, int]]]:
    """Spans of each text that the tagger adds to its base spans."""
    out: list[list[tuple[int, int, int]]] = []
    for text, known, found in zip(texts, base, tagger.spans(texts, _signs)):
        own = []
        for kind, a, b, p in found:
            a, b = _edges(kind, text, a, b)
            whole = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            # Check digits and their number tell cards from phones.
            if kind >= 2 and whole and (card := _card_around(text, a, b)):
                kind, (a, b) = 2, card
            fits = [k for k in ((2, 3) if kind >= 2 else (kind,)) if well_formed(k, text[a:b])]
            if fits == [3] and _other_number(text, a, b):
                continue
            if p >= least and whole and fits and all(b <= x or y <= a for _, x, y in known):
                own.append((fits[0], a, b))
        out.append(_apart(own))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _both(texts: list[str], tagger: Tagger) -> tuple[list, list]:
    """Base and added spans, the tagger run over some texts at a time."""
    base = [base_spans(text) for text in texts]
    added: list = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
            size += len(texts[to])
            to += 1
        added += added_spans(texts[at:to], base[at:to], tagger)
        at = to
    return base, added


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of docs (doc_id, text).

    The counts and the digest are of the base spans; spans lists all. A null text counts as an
    empty one, without spans. doc_id may be null or repeated; other columns aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            base, added = _both([x or "" for x in batch.column(1).to_pylist()], tagger)
            counts = [pa.array([sum(k == kind for k, _, _ in spans) for spans in base], pa.int64()) for kind in range(4)]
            digest = pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base])
            spans = pa.array([_joined(a + b) for a, b in zip(base, added)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.by_text(run, 1), schema)


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span in text (overlapping ones together) replaced by its kind, as in [EMAIL].

    Columns are kept; n_chars, if there is one, is counted anew. Null texts stay. Rows and their number don't change.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            base, added = _both([x or "" for x in texts], tagger)
            changed = {i: replaced(texts[i], a + b) for i, (a, b) in enumerate(zip(base, added)) if a or b}
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(texts)], batch.schema.field(at).type)
                if "n_chars" in batch.schema.names:
                    k = batch.schema.names.index("n_chars")
                    columns[k] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(columns[k].to_pylist())], batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(common.by_text(run, at), docs.schema)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    merged: list[list[int]] = []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans' counts and digest, and all spans, of every text of documents."""
    return found(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
