"""Surrogates for personal data: keyed, type-consistent replacements.

An entity is (type, normal form): a phone number is its digits whatever stands between them, an e-mail address its lower case, a name its folded words.
The surrogate comes from a keyed hash of the entity and an attempt number, in the entity's own normal form, and each mention is rendered in its own
layout (separators, letter case, script). So one entity has one surrogate in all documents. Distinctness is checked over the whole corpus: no two
entities may share a surrogate and no surrogate may be a real entity; who loses tries again with the next attempt. What the check decides is a short
list of entities whose attempt is not 0. Surrogates of kinds whose formats allow it (names, addresses, domains, phone numbers) grow with the attempt, so
that there are enough for any number of entities.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.session import discard, materialize

#: Rows (one for each text with such an entity) up to which the list of later attempts is broadcast; beyond, it is joined by document.
BROADCAST_RETRIES = 20_000
#: Rows that a worker rewrites at a time.
SLICE = 512

# Titles that announce a person's name, by the gender that they tell.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sig", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа"],
    "u": ["Dr", "Prof", "Mx"],
}
_TITLE = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_NAME_WORD = r"[^\W\d_a-zß-öø-ÿа-яα-ω][\w’'-]*"
_NAME = re.compile(rf"\b({'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\.?[  ]({_NAME_WORD}(?:[  ]{_NAME_WORD}){{0,2}})")
_EMAIL = re.compile(r"(?<![\w.+%-])[\w%+-](?:[\w.%+-]{0,62}[\w%+-])?@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,6}[^\W\d_]{2,24}(?![\w-])")
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_DIGIT = re.compile(r"\d")
_SECRET = re.compile(r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-(?:[a-z]{2,8}-)?[A-Za-z0-9]{20,})(?!\w)")

TYPES = ("email", "phone", "ipv4", "card", "ssn", "iban", "secret", "person", "ipv6")


def digits_of(text: str) -> str:
    """The digits of a text, of any script, as 0 to 9."""
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdecimal())


def domain_of(address: str) -> str:
    return address.rpartition("@")[2]


def _ipv6(text: str) -> str | None:
    """The eight groups of an address that is not a loopback or empty one."""
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return found.exploded if int(found) > 1 else None


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _same(one: str, other: str) -> bool:
    return one == other or "u" in (one, other)


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, "person", normal form) of the names of a text: those after a title, and their full names and surnames elsewhere.

    Titled names of the same words are one person where the genders of their titles allow it, and a titled surname is the person with that surname and
    such a gender, the last one named before it or else the first after it. All mentions of a person have the fullest normal form.
    """
    titled = []
    for m in _NAME.finditer(text):
        name = re.sub(r"[’'][sS]?$", "", m[2])
        titled.append((m.start(2), m.start(2) + len(name), _TITLE[m[1].casefold()], tuple(name.casefold().split())))
    if not titled:
        return []
    people: list[list] = []  # first start, gender, words
    who = {}

    def find(at: int, gender: str, fits) -> int | None:
        fit = [i for i, (_, g, words) in enumerate(people) if _same(g, gender) and fits(words)]
        before = [i for i in fit if people[i][0] <= at]
        return max(before, key=lambda i: people[i][0]) if before else min(fit, key=lambda i: people[i][0], default=None)

    # gendered titles first, full names before surnames, so that the others find what they may stand for
    for start, _, gender, words in sorted(titled, key=lambda t: (len(t[3]) == 1, t[2] == "u", t[0])):
        i = find(start, gender, lambda w, words=words: w == words or (len(words) == 1 and w[-1:] == words))
        if i is None:
            i = len(people)
            people.append([start, gender, words])
        people[i][0] = min(people[i][0], start)
        who[start] = i
    norms = [f"{g}:{' '.join(words)}" for _, g, words in people]
    out = [(start, end, "person", norms[who[start]]) for start, end, *_ in titled]
    forms = {w for _, _, words in people for w in (words, words[-1:])}
    taken, k = sorted((start, end) for start, end, *_ in titled), 0
    any_form = "|".join("[ \u00a0]".join(map(re.escape, w)) for w in sorted(forms, key=lambda w: (-len(w), w)))
    for m in re.finditer(rf"(?<![\w@])(?:{any_form})(?![\w@])", text, re.IGNORECASE):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        words = tuple(m[0].casefold().split())
        if words not in forms or any(w[:1].islower() for w in m[0].split()) or (k < len(taken) and taken[k][0] < m.end()):
            continue
        i = find(m.start(), "u", lambda w: w == words or (len(words) == 1 and w[-1:] == words))
        out.append((*m.span(), "person", norms[i]))
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order, none inside another."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if ":" in text:
        found += [(*m.span(), "ipv6", n) for m in _IPV6.finditer(text) if (n := _ipv6(m[0]))]
    if _DIGIT.search(text):
        found += [(*m.span(), "secret", m[0]) for m in _SECRET.finditer(text) if any(map(str.isdigit, m[0]))]
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if plain.isascii() and 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
                found.append((*m.span(), "iban", plain))
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            if len(digits) >= 13 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1:
                found.append((*m.span(), "card", digits))
        found += [(*m.span(), "ipv4", m[0]) for m in _IPV4.finditer(text) if m[0].isascii()]
        found += [(*m.span(), "ssn", digits_of(m[0])) for m in _SSN.finditer(text)]
        for m in _PHONE.finditer(text):
            digits = digits_of(m[0])
            if 8 <= len(digits) <= 15:
                found.append((*m.span(), "phone", digits))
    found += persons(text)
    found.sort(key=lambda e: (e[0], TYPES.index(e[2])))
    out, end = [], -1
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


class _Stream:
    """Numbers below given bounds from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.k, self.pool = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool = hashlib.blake2b(self.seed + self.k.to_bytes(8, "little"), digest_size=64).digest()
            self.k += 1
        x, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return x % n

    def pick(self, items: str | list[str]) -> str:
        return items[self.below(len(items))]

    def shaped(self, text: str) -> str:
        """Each digit by a digit, each letter by a letter of its case and script; all else stays."""
        kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        other = lambda c: self.pick(LETTERS[script_of(c)]) if c.isalpha() else c
        return "".join(next((self.pick(k) for k in kinds if c in k), None) or other(c) for c in text)


# Syllables and endings from which names are made, by script; endings by gender (u: either).
_NAMES = {
    "latin": (["ba", "da", "do", "fe", "ga", "ka", "le", "li", "lo", "ma", "mi", "na", "ne", "pa", "ra", "ro", "sa", "se", "ta", "vi", "ze"], {"m": ["n", "r", "s", "ld"], "f": ["a", "ia", "ine", "elle"], "u": ["el", "y"]}),
    "cyrillic": (["ба", "ва", "да", "ди", "ка", "ла", "ле", "ма", "ми", "на", "ни", "ра", "ро", "са", "та", "ти"], {"m": ["н", "р", "й"], "f": ["на", "ра", "я"], "u": ["ко"]}),
    "greek": (["βα", "γα", "δα", "κα", "λα", "λε", "μα", "μι", "να", "νι", "ρα", "σα", "τα", "τι"], {"m": ["ς", "ων"], "f": ["α", "η"], "u": ["ου"]}),
    "cjk": (["安", "白", "成", "方", "高", "和", "江", "林", "明", "宁", "平", "青", "山", "石", "文", "武", "新", "永", "元", "志"], {"m": [""], "f": [""], "u": [""]}),
}


# Letters that stand for one beyond a-z in an address, by script.
LETTERS = {"latin": "àáâäçèéêëìíîïñòóôöùúûü", "cyrillic": "абвгдежзиклмнопрсту", "greek": "αβγδεζηθικλμνξοπρστυ", "cjk": "安白成方高和江林明宁平青山石文武新永元志"}


def script_of(word: str) -> str:
    c = max(word, default="a")
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "cjk" if c >= "぀" else "latin"


def _name(s: _Stream, word: str, ends: list[str], attempt: int) -> str:
    """A name like ``word``: parts between hyphens and apostrophes are made each for itself, and an accent stays an accent."""
    syllables = _NAMES[script_of(word)][0]
    parts = re.split(r"([-’'])", word)
    last = max(i for i, p in enumerate(parts) if i % 2 == 0 and (p or i == 0))
    for i, p in enumerate(parts):
        if i % 2 or not p:
            continue
        if len(p) == 1 and i < last:  # O'Neil
            parts[i] = s.pick(syllables)[-1]
            continue
        count = (2 if script_of(word) == "cjk" else 2 + s.below(2)) + (attempt // 2 if i == last else 0)
        made = "".join(s.pick(syllables) for _ in range(count))
        marked = [c for c in p if c > "z" and script_of(c) == "latin"]
        if marked:
            made = made[:-1] + s.pick(marked)
        parts[i] = made + (s.pick(ends) if i == last else "")
    return "".join(parts)


def surrogate(key: bytes, kind: str, norm: str, attempt: int, above: int = 0) -> str:
    """The surrogate's normal form; ``above`` is the attempt of an address's domain."""
    s = _Stream(key, kind, norm, attempt)
    if kind == "domain":
        *labels, top = norm.split(".")
        more = "".join(s.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(attempt // 2))
        return f"{'.'.join(map(s.shaped, labels))}{more}.{top}"
    if kind == "email":
        # a domain is an entity of its own: all its addresses move to the same new domain
        more = "".join(s.pick("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(attempt // 2))
        return f"{s.shaped(norm.rpartition('@')[0])}{more}@{surrogate(key, 'domain', domain_of(norm), above)}"
    if kind == "ipv4":
        return ".".join(str(1 + s.below(254) if i in (0, 3) else s.below(256)) for i in range(4))
    if kind == "ipv6":  # groups of zeros stay, so that a mention's layout holds; after a while the others have all four digits
        size = lambda g: 16 ** (4 if attempt >= 4 else len(g.lstrip("0")))
        return ":".join(g if g == "0000" else f"{1 + s.below(size(g) - 1):04x}" for g in norm.split(":"))
    if kind == "card":
        body = norm[0] + s.shaped(norm[1:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        rest = s.shaped(norm[4:])
        return norm[:2] + iban_check(norm[:2], rest) + rest
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "phone":  # what leads (country, trunk) stays, and the zeros and ones that numbering plans give a meaning
        keep = 1 if len(norm) <= 11 else 2
        more = "".join(s.pick("0123456789") for _ in range(attempt // 8))
        return norm[:keep] + "".join(c if c == "0" and i == 0 else s.pick("23456789") if i == 0 else s.pick("0123456789") for i, c in enumerate(norm[keep:])) + more
    if kind == "secret":
        head = re.match(r"AKIA|gh[pousr]_|sk-(?:[a-z]{2,8}-)?", norm)
        if head:
            return head[0] + s.shaped(norm[head.end() :])
        return "".join(s.pick("0123456789abcdef" if norm.lower() == norm else "0123456789ABCDEF") for _ in norm)
    gender, _, name = norm.partition(":")
    words = name.split(" ")
    # the first of several words is the given name and tells the gender; names grow with the attempt
    made = [_name(s, w, _NAMES[script_of(w)][1][gender if i == 0 and len(words) > 1 else "u"], attempt) for i, w in enumerate(words)]
    return f"{gender}:{' '.join(made)}"


def _cased(was: str, new: str) -> str:
    """``new`` in the letter case of ``was``: all upper, or a capital at the start of each part."""
    letters = [c for c in was if c.isalpha()]
    if len(letters) > 1 and was.isupper():
        return new.upper()
    parts, old = re.split(r"([-’'])", new), re.split(r"([-’'])", was)
    return "".join(p[:1].upper() + p[1:] if i < len(old) and old[i][:1].isupper() else p for i, p in enumerate(parts))


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the layout of a mention; one of a surname alone has its last word."""
    if kind in ("phone", "card", "ssn"):
        it = iter(new)
        script = lambda c: chr(ord(c) - unicodedata.digit(c) + int(next(it)))
        return "".join([script(c) if c.isdecimal() else c for c in mention]) + "".join(it)
    if kind == "iban":
        it = iter(new)
        return "".join(next(it) if c != " " else c for c in mention)
    if kind == "email":
        if mention.isupper():
            return new.upper()
        (old, _, old_domain), (local, _, domain) = mention.rpartition("@"), new.rpartition("@")
        like = lambda a, b: "".join(y.upper() if i < len(a) and a[i].isupper() else y for i, y in enumerate(b))
        return f"{like(old, local)}@{like(old_domain, domain)}"
    if kind == "ipv6":
        groups, (head, _, tail) = new.split(":"), mention.partition("::")
        front, back = head.split(":") if head else [], tail.split(":") if tail else []
        shown = lambda olds, news: ":".join(f"{int(n, 16):0{len(o)}x}" for o, n in zip(olds, news, strict=True))
        out = shown(front, groups[: len(front)]) + ("::" if "::" in mention else "") + (shown(back, groups[len(groups) - len(back) :]) if back else "")
        return out.upper() if mention.isupper() else out
    if kind == "person":
        words = new.partition(":")[2].split(" ")
        old, fresh = re.split(r"([ \u00a0])", mention), iter(words[-1:] if len(mention.split()) == 1 else words)
        return "".join(w if not w.strip() else _cased(w, next(fresh)) for w in old if w)
    return new


def _replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int], memo: dict) -> tuple[str, list[int]]:
    parts, at, counts = [], 0, [0] * len(TYPES)
    for start, end, kind, norm in detect(text):
        which = kind, norm, attempts.get((kind, norm), 0), attempts.get(("domain", domain_of(norm)), 0) if kind == "email" else 0
        new = memo.get(which)
        if new is None:
            if len(memo) > 100_000:
                memo.clear()
            new = memo[which] = surrogate(key, *which)
        parts += [text[at:start], render(kind, text[start:end], new)]
        at = end
        counts[TYPES.index(kind)] += 1
    return "".join([*parts, text[at:]]), counts


def mentions(keyed: DataFrame) -> DataFrame:
    """(__row, kind, norm): the distinct entities of each (__row, __text), with the domains of addresses. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, t in zip(batch.column("__row").to_pylist(), batch.column("__text"), strict=True):
                found = dict.fromkeys((e[2], e[3]) for e in detect(t.as_py())) if t.is_valid else {}
                found |= dict.fromkeys(("domain", domain_of(n)) for k, n in list(found) if k == "email")
                out += [(r, k, n) for k, n in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["__row", "kind", "norm"])

    return keyed.select("__row", "__text").mapInArrow(run, "__row long, kind string, norm string")


def visible(kind: str, norm: str) -> str:
    """What a reader sees of a normal form: a name without the gender of its title."""
    return norm.partition(":")[2].casefold() if kind == "person" else norm


#: Rounds without an entity that settles, after which a kind's fixed format is held to be used up.
STUCK = 200


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) of the distinct entities (kind, norm, above) whose attempt 0 would clash; after it, surrogates are distinct and none is a real entity.

    Surrogates are compared as they are seen, names without their gender. Of those that want one surrogate the least keeps it, the rest move on; an entity that has settled is not moved by a later one.
    It ends when all have settled. Only where a kind's format fixes the number of its values (IPv4, social security, card and account numbers, hashes) and
    the corpus holds nearly all of them is there no answer; then it raises.
    """

    @F.udf("string", useArrow=True)
    def make(kind, norm, attempt, above):
        return visible(kind, surrogate(key, kind, norm, attempt, above))

    @F.udf("string", useArrow=True)
    def seen(kind, norm):
        return visible(kind, norm)

    real = materialize(entities.select("kind", seen("kind", "norm").alias("new")).distinct(), "real")
    settled, open_, n_open, stuck = None, entities.withColumn("attempt", F.lit(0)), -1, 0
    while stuck < STUCK:
        tried = materialize(open_.withColumn("new", make("kind", "norm", "attempt", "above")), "tried")
        first = tried.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        good = first.join(real, ["kind", "new"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("kind", "new"), ["kind", "new"], "left_anti")
        good = materialize(tried.join(good, ["kind", "norm", "new"], "left_semi"), "settled")
        lost = materialize(tried.join(good, ["kind", "norm"], "left_anti").select("kind", "norm", "above", (F.col("attempt") + 1).alias("attempt")), "lost")
        discard(tried)
        discard(open_)
        settled = good if settled is None else settled.unionByName(good)
        left = lost.count()
        if not left:
            discard(real)
            return settled.where("attempt > 0").select("kind", "norm", "attempt")
        stuck = stuck + 1 if left == n_open else 0
        open_, n_open = lost, left
    raise RuntimeError("the corpus uses up the values that the format of a kind allows")


def settle_all(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) of the later attempts among the entities ``found`` (kind, norm): domains first, as addresses stand on them."""
    entities = materialize(found.select("kind", "norm").distinct(), "entities")
    domains = materialize(settle(entities.where("kind = 'domain'").withColumn("above", F.lit(0)), key), "domains")
    mine = domains.select(F.col("norm").alias("__d"), F.col("attempt").alias("__a"))
    rest = entities.where("kind <> 'domain'").join(mine, (F.col("kind") == "email") & (F.substring_index("norm", "@", -1) == F.col("__d")), "left")
    return domains.unionByName(settle(rest.select("kind", "norm", F.coalesce("__a", F.lit(0)).alias("above")), key))


def _rewriter(key: bytes, n_kept: int):
    """Rows (__text, __later, kept columns) -> (kept columns, new text, counts by type), in slices, so that a batch is not held twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts, counts = [], []
                for text, later in zip(part.column(0), part.column(1), strict=True):
                    attempts = {(x["kind"], x["norm"]): x["attempt"] for x in later.as_py() or ()}
                    new, n = (None, [0] * len(TYPES)) if not text.is_valid else _replaced(text.as_py(), key, attempts, memo)
                    texts.append(new)
                    counts.append(n)
                found = [pa.array([n[i] for n in counts], pa.int32()) for i in range(len(TYPES))]
                names = [*part.schema.names[2:], "__text", *(f"__n_{t}" for t in TYPES)]
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(n_kept)), pa.array(texts, pa.string()), *found], names)

    return run


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``text_col`` rewritten, n_entities, and counts by type (``pii_<type>``).

    A null text stays null and has no entities, nor has an empty one; very long texts are read whole; rows that share an id or a text are rewritten each
    for itself, and alike; an empty table gives an empty result. Where a kept column has the name of a count, the count's name gets a ``_`` more. Of
    entities that want one surrogate the least (by code point) has it. Rows are known by a hash of their text, which does not depend on how a job splits
    the files; what equal hashes share is a list of attempts, which fits any text. Text is not shuffled while the texts with an entity of a later
    attempt are at most BROADCAST_RETRIES; beyond, it is, once.
    """
    cols = list(keep) if keep else docs.columns
    others = [c for c in cols if c != text_col]
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("__row"), text.alias("__text"), *(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(others)))
    found = materialize(mentions(keyed), "mentions")
    retries = settle_all(found, key)
    lists = found.join(retries, ["kind", "norm"]).groupBy(F.col("__row").alias("__r")).agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("__later"))
    lists = materialize(lists, "later")
    discard(found)
    hint = F.broadcast if lists.count() <= BROADCAST_RETRIES else (lambda x: x)
    joined = keyed.join(hint(lists), F.col("__row") == F.col("__r"), "left").select("__text", "__later", *(f"__k{i}" for i in range(len(others))))
    kept = [f for f in joined.schema.fields if f.name.startswith("__k")]
    schema = T.StructType([*kept, T.StructField("__text", T.StringType()), *(T.StructField(f"__n_{t}", T.IntegerType()) for t in TYPES)])
    out = joined.mapInArrow(_rewriter(key, len(kept)), schema)
    source = {text_col: "__text"} | {c: f"__k{i}" for i, c in enumerate(others)}
    free = lambda name: free(name + "_") if name in cols else name
    n = reduce(Column.__add__, (F.col(f"__n_{t}") for t in TYPES), F.lit(0)).alias(free("n_entities"))
    return out.select(*(F.col(source[c]).alias(c) for c in cols), n, *(F.col(f"__n_{t}").alias(free(f"pii_{t}")) for t in TYPES))
