"""Personal data replaced by surrogates.

What is found in a text is replaced by something of the same kind and form: digits by
digits, letters by letters of the same case, an address by one of the same class, a
card number by one whose check digit is as right or wrong, a name by one of the same
script and gender. A surrogate is drawn with a secret key from the kind and the
canonical value, so one person's data look alike in every text, however they are
written: coreference stays. A name found once in a text is looked for again in all of it,
so a later bare surname gets the surrogate of the first.

Names are found after a title of address, or as a listed given name before a capitalised
word; a name with neither, or one in a language whose titles follow it, is not found.

Distinctness is checked over the whole corpus: no two values of a kind share a
surrogate, and no surrogate is a value that the corpus itself holds. Values that fail
draw again, in rounds over the shrinking rest. Where a space is too small it gives way,
draw by draw: names, words of addresses and numbers grow longer, private networks turn
into the largest of them and that into public ones. Nearly all keep their first draw, which
a task works out by itself; only those that drew again are joined to their documents.

NULL text stays NULL. Text without personal data stays as it is. A very long text is
searched whole. A NULL id is kept, rows that repeat get the same text. Rows are numbered by
position, so ``replace`` needs a table's rows. An empty table gives an empty result. Other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlight.llm.texts import packed, row_number
from benchlight.session import settle

KEY = "surrogate"
# Draws after which a space gives way a little more.
PATIENCE = 8
# Digits by which a phone number is known, with or without its country code.
NATIONAL = 10

# --- what is found ------------------------------------------------------------
_EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
_IP = r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))"
_SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
_IBAN = r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
_CARD = (
    r"(?P<card>(?<![\w-])(?:3[47]\d{2}[ -]?\d{6}[ -]?\d{5}"
    r"|(?:[3-6]\d{3}|2[2-7]\d{2})(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-]))"
)
_IP6 = r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d))"
_PHONE = r"(?P<phone>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
_SECRET = (
    r"(?P<secret>(?<=[=:\"' ])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})"
    r"|(?<![\w.-])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{16,}(?!\w))"
)
_NUMERIC = re.compile("|".join([_EMAIL, _SECRET, _IBAN, _IP, _IP6, _SSN, _CARD, _PHONE]))
_ASSIGNED = re.compile(
    r"(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/=.-]{8,})"
)
_PREFIX = re.compile(r"(?:AKIA|gh[pousr]_|sk-|xox[baprs]-)?")
_HINT = re.compile(r"[0-9@]|::")

# Titles of address by gender, and given names by gender. Fixed values.
_TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor"),
}
_GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Peter",
          "Daniel", "Matthew", "Anthony", "Paul", "Steven", "Andrew", "Kevin", "Brian", "George", "Edward",
          "Jason", "Ryan", "Jacob", "Oliver", "Harry", "Jack", "Liam", "Noah", "Ethan", "Lucas", "Adam", "Simon",
          "Hans", "Karl", "Jürgen", "Klaus", "Wolfgang", "Stefan", "Felix", "Jonas", "Pierre", "Jean", "Michel",
          "François", "Louis", "Antoine", "José", "Carlos", "Juan", "Miguel", "Javier", "Diego", "Pablo",
          "Иван", "Сергей", "Александр", "Дмитрий", "Алексей", "Николай", "Γιώργος", "Νίκος", "Κώστας"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Karen", "Anna",
          "Emma", "Olivia", "Sophia", "Isabella", "Mia", "Amelia", "Emily", "Jessica", "Laura", "Rebecca", "Nancy",
          "Lisa", "Margaret", "Sandra", "Ashley", "Michelle", "Amanda", "Helen", "Alice", "Lucy", "Hannah", "Julia",
          "Petra", "Ursula", "Monika", "Sabine", "Claudia", "Katrin", "Marie", "Françoise", "Nathalie", "Sophie",
          "Camille", "Chloé", "María", "Carmen", "Lucía", "Elena", "Isabel", "Ana",
          "Ольга", "Елена", "Наталья", "Мария", "Татьяна", "Ирина", "Μαρία", "Ελένη", "Κατερίνα"),
}
_TITLE_OF = {t: g for g, ts in _TITLES.items() for t in ts}
_GIVEN_OF = {n: g for g, ns in _GIVEN.items() for n in ns}
_WORD = r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(_TITLE_OF)})\.? (?P<name>{_WORD}(?: {_WORD})?)")
_NAMED = re.compile(rf"\b(?P<given>{'|'.join(_GIVEN_OF)}) (?P<surname>{_WORD})")

# --- what replaces it ---------------------------------------------------------
# Syllables of names by script, and the endings by which a gender shows.
_SYLLABLES = {
    "latin": ("ba", "cor", "da", "el", "fen", "gar", "hol", "jo", "ka", "lin", "mar", "nor", "per", "ra", "sel",
              "tor", "ul", "ver", "wen", "zan"),
    "cyrillic": ("ба", "вор", "да", "ел", "гра", "зо", "кор", "ли", "мар", "нов", "пет", "ра", "сел", "тор", "ул"),
    "greek": ("βα", "γο", "δη", "ελ", "ζα", "θε", "κο", "λι", "μαρ", "νι", "πετ", "ρα", "σο", "τα", "φι"),
}
# "s" ends a surname, "sf" a woman's where it shows.
_ENDINGS = {
    "latin": {"m": "o", "f": "a", "n": "en", "s": "er"},
    "cyrillic": {"m": "ий", "f": "ия", "n": "ей", "s": "ов", "sf": "ова"},
    "greek": {"m": "ος", "f": "α", "n": "ις", "s": "ιδης", "sf": "ιδου"},
}
_WOMANS = {"cyrillic": ("ова", "ева", "ёва", "ина", "ына", "ая"), "greek": ("ου", "ά", "ή")}
# Scripts without capitals: the letters that their surrogates are made of, by first code points.
_CASELESS = (
    ("\u0590", "\u05ff", "אבגדהזחילמנרשת"),
    ("\u0600", "\u06ff", "ابتجحدرزسشعفكلمنهي"),
    ("\u0900", "\u097f", "अकगचजतदनपमरलवसह"),
    ("\u0e00", "\u0e7f", "กขคจชดตทนบปพมยรลวสห"),
    ("\u3040", "\u30ff", "アイウエオカキクケコサシスセソタチツテトナニヌネノハマミムメモヤユヨラリルレロワ"),
    ("\uac00", "\ud7af", "강고구김나도문민박배서성송신안양오유윤이임장전정조주지최한홍"),
    ("\u3400", "\u9fff", "丁于任何余冯刘吕周唐姚孙宋崔张彭徐曹朱李杜林梁江沈王田石罗胡苏范董蒋袁许谢赵邓郑郭钟陈韩马高魏黄"),
)


class _Draw:
    """Numbers from the key, the kind, the value and the attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        seed = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key.encode()[:64], digest_size=64)
        self.left, self.seed = int.from_bytes(seed.digest(), "big"), seed.digest()

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.seed = hashlib.blake2b(self.seed, digest_size=64).digest()
            self.left = int.from_bytes(self.seed, "big")
        self.left, got = divmod(self.left, n)
        return got


def script(word: str) -> str:
    letter = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= letter <= "ӿ" else "greek" if "Ͱ" <= letter <= "Ͽ" else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Spans (begin, end, kind, canonical value) that don't overlap, in order."""
    spans: list[tuple[int, int, str, str]] = []
    if _HINT.search(text):
        for m in _NUMERIC.finditer(text):
            if m.lastgroup != "ip6" or _is_address(m.group()):
                spans.append((*m.span(), m.lastgroup, canonical(m.lastgroup, m.group())))
        for m in _ASSIGNED.finditer(text):
            spans.append((*m.span("secret"), "secret", m.group("secret")))
    named = list(_names(text))
    spans += named
    if named:
        spans += _again(text, named)
    spans.sort(key=lambda s: (s[0], -s[1]))
    kept, end = [], 0
    for s in spans:
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def _is_address(text: str) -> bool:
    """Whether a text is an IPv6 address that hosts have: global, local to a site or a link."""
    try:
        address = int(ipaddress.IPv6Address(text))
    except ValueError:
        return False
    return address >> 125 == 0b001 or address >> 121 == 0b1111110 or address >> 118 == 0b1111111010


def _is_capital(word: str) -> bool:
    """Whether a word begins like a name: with no small letter, as some scripts have no others."""
    return not word[0].islower()


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _TITLED.finditer(text):
        words = list(re.finditer(_WORD, m.group("name")))
        if not _is_capital(words[0].group()):
            continue
        words = [w for w in words if _is_capital(w.group())]
        for i, w in enumerate(words):
            gender = _TITLE_OF[m.group("title")]
            at = m.start("name")
            yield at + w.start(), at + w.end(), _name_kind(w.group(), i == len(words) - 1, gender), w.group().title()
    for m in _NAMED.finditer(text):
        if m.group("surname")[0].isupper():
            for part, is_last in (("given", False), ("surname", True)):
                word = m.group(part)
                yield *m.span(part), _name_kind(word, is_last, "n"), word.title()


def _name_kind(word: str, is_last: bool, gender: str) -> str:
    """A listed given name is one wherever it stands; else the last word is the surname."""
    if word.title() in _GIVEN_OF:
        return f"name-{_GIVEN_OF[word.title()]}"
    if not is_last:
        return f"name-{gender}"
    return "name-sf" if word.lower().endswith(_WOMANS.get(script(word), "\0")) else "name-s"


def _again(text: str, named: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Where the words of names that were found stand by themselves."""
    kinds = {text[begin:end]: (kind, value) for begin, end, kind, value in named if end - begin > 1}
    kinds |= {w.title(): k for w, k in kinds.items()} | {w.upper(): k for w, k in kinds.items()}
    either = "|".join(map(re.escape, sorted(kinds, key=len, reverse=True)))
    for m in re.finditer(rf"(?<![^\W\d_])(?:{either})(?![^\W\d_])", text) if kinds else ():
        yield *m.span(), *kinds[m.group()]


def canonical(kind: str, value: str) -> str:
    """One spelling for all the ways to write a value."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in value if c.isdigit())
        return digits[-NATIONAL:] if kind == "phone" else digits
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value.replace(" ", "") if kind == "iban" else value


def surrogate(kind: str, value: str, key: str = KEY, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    draw = _Draw(key, kind, value, attempt)
    wider = attempt // PATIENCE
    if kind.startswith("name-"):
        letters = next((of for low, high, of in _CASELESS if low <= value[0] <= high), None)
        if letters:
            return "".join(letters[draw.below(len(letters))] for _ in range(max(2, len(value)) + wider))
        own, ending = script(value), kind.removeprefix("name-")
        parts = _SYLLABLES[own]
        stem = "".join(parts[draw.below(len(parts))] for _ in range(2 + attempt // 4 + draw.below(2)))
        return (stem + _ENDINGS[own].get(ending, _ENDINGS[own][ending[0]])).title()
    if kind == "ip":
        return _network(value, draw, wider)
    if kind == "ip6":
        first, *rest = value.split(":")
        return ":".join([first, *(g if int(g, 16) == 0 else _hexadecimal(g, draw, wider) for g in rest)])
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        more = "".join(chr(97 + draw.below(26)) for _ in range(wider))
        return _alike(local, draw) + more + "@" + ".".join([_alike(x, draw) for x in labels[:-1]] + labels[-1:])
    if kind == "card":
        body = value[0] + _alike(value[1:-1] + "0" * wider, draw)
        right = _luhn(value[:-1])
        last = _luhn(body)
        return body + (last if value[-1] == right else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = _alike(value[4:] + "0" * wider, draw)
        return value[:2] + _iban_check(value[:2], body) + body
    if kind == "phone":
        return _alike(value + "0" * wider, draw, first_nonzero=True)
    prefix = _PREFIX.match(value).group() if kind == "secret" else ""
    return prefix + _alike(value[len(prefix) :] + "0" * wider, draw)


def _network(value: str, draw: _Draw, wider: int) -> str:
    """An address in the same private network, or a public one for a public one."""
    octets = [int(o) for o in value.split(".")]
    low = [draw.below(254) + 1 for _ in range(4)]
    first, second = octets[:2]
    if first in (10, 127) or (first == 192 and second == 168) or (first == 172 and 16 <= second < 32) or (
        first == 169 and second == 254
    ):
        if wider < 1 and first == 172:
            return ".".join(map(str, [172, 16 + low[1] % 16, *low[2:]]))
        if wider < 1 and first in (169, 192):
            return ".".join(map(str, [first, second, *low[2:]]))
        if wider < 4:
            return ".".join(map(str, [first if first == 127 else 10, *low[1:]]))
    public = [o for o in range(11, 224) if o not in (100, 127, 169, 172, 192)]
    return ".".join(map(str, [public[draw.below(len(public))], *low[1:]]))


def _hexadecimal(group: str, draw: _Draw, wider: int) -> str:
    """A group that is as long without its leading zeros, or longer where spaces are small."""
    digits = min(4, len(group.lstrip("0")) + wider)
    return f"{16 ** (digits - 1) + draw.below(15 * 16 ** (digits - 1)):04x}"


_HEX = re.compile(r"[0-9a-f]+")


def _alike(text: str, draw: _Draw, first_nonzero: bool = False) -> str:
    """Digits for digits, letters for letters of the same case; hexadecimal stays so."""
    letters = 6 if len(text) >= 16 and _HEX.fullmatch(text) else 26
    out = []
    for c in text:
        if c.isdigit():
            n = draw.below(9) + 1 if first_nonzero and not out else draw.below(10)
            out.append(str(n))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(letters)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> str:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def written(kind: str, original: str, value: str) -> str:
    """A canonical surrogate in the form the original was written in."""
    if kind in ("phone", "card", "ssn", "iban"):
        # A country code before the national number stays.
        digits = [c for c in original if c.isdigit()]
        left = iter([*digits[:-NATIONAL], *value] if kind == "phone" else value)
        keeps = str.isalnum if kind == "iban" else str.isdigit
        return "".join(next(left, "0") if keeps(c) else c for c in original) + "".join(left)
    if kind == "email":
        local, _, domain = original.partition("@")
        like = f"{local.ljust(value.index('@'), 'x')}@{domain}"
        return "".join(v.upper() if o.isupper() else v for o, v in zip(like, value, strict=True))
    if kind == "ip6":
        return _written_groups(original, value.split(":"))
    if kind.startswith("name-"):
        return value.upper() if original.isupper() and len(original) > 1 else value
    return value


def _written_groups(original: str, groups: list[str]) -> str:
    """Groups in the places, and with the leading zeros and case, of an address as written."""
    head, gap, tail = original.partition("::")

    def part(text: str, of: list[str]) -> str:
        named = text.split(":") if text else []
        own = of[: len(named)] if of is groups else of[len(of) - len(named) :]
        return ":".join(g.lstrip("0").zfill(len(w)) for w, g in zip(named, own, strict=True))

    new = part(head, groups) + gap + part(tail, groups[:])
    return new.upper() if original.upper() == original and original.lower() != original else new


def replaced(text: str, drawn_again: dict[tuple[str, str], int], key: str = KEY) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced, in order."""
    out, end, kinds = [], 0, []
    for begin, finish, kind, value in find(text):
        new = surrogate(kind, value, key, drawn_again.get((kind, value), 0))
        out += [text[end:begin], written(kind, text[begin:finish], new)]
        end = finish
        kinds.append(kind)
    return "".join(out) + text[end:] if kinds else text, kinds


# --- over a corpus ------------------------------------------------------------
def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``kind`` and ``value`` of what is found, once per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [
                (row, kind, value)
                for row, body in zip(rows["row"], rows["text"], strict=True)
                for kind, value in ({(k, v) for _, _, k, v in find(body)} if body else ())
            ]
            yield pd.DataFrame(found, columns=["row", "kind", "value"])

    rows = docs.select(
        row_number(docs).alias("row"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInPandas(run, "row bigint, kind string, value string")


def redrawn(found: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``value`` and ``attempt`` of the values whose first draw is taken.

    Of values with one surrogate the least keeps it. A surrogate that the corpus holds
    as a value of its kind is nobody's.
    """

    @F.pandas_udf("string")
    def draw(kinds: pd.Series, values: pd.Series, attempts: pd.Series) -> pd.Series:
        triples = zip(kinds, values, attempts, strict=True)
        return pd.Series([surrogate(k, v, key, int(a)) for k, v, a in triples], dtype=object)

    values = settle(found.select("kind", "value").distinct())
    # Names of one script and any gender or place must differ in text, so they share a space.
    space = F.when(F.col("kind").startswith("name-"), "name").otherwise(F.col("kind"))
    held = values.select(space.alias("space"), F.col("value").alias("drawn")).distinct()
    pending = values.withColumn("attempt", F.lit(0))
    given: DataFrame | None = None
    attempt = 0
    while True:  # spaces widen, so it ends
        drawn = settle(
            pending.withColumn("drawn", draw("kind", "value", "attempt")).withColumn("space", space)
        )
        free = drawn.join(held, ["space", "drawn"], "left_anti")
        if given is not None:
            free = free.join(given, ["space", "drawn"], "left_anti")
        first = free.groupBy("space", "drawn").agg(F.min(F.concat_ws("\0", "value", "kind")).alias("first"))
        won = settle(
            free.join(first, ["space", "drawn"])
            .filter(F.concat_ws("\0", "value", "kind") == F.col("first"))
            .select("space", "drawn", "kind", "value", "attempt")
        )
        given = won if given is None else given.unionByName(won)
        rest = settle(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value"))
        if rest.isEmpty():
            return given.filter("attempt > 0").select("kind", "value", "attempt")
        attempt += 1
        pending = rest.withColumn("attempt", F.lit(attempt))


def replace(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The rows as ``doc`` beside ``replaced``, the text with surrogates, and ``kinds``."""
    found = settle(occurrences(docs, text))
    again = (
        found.join(redrawn(found, key), ["kind", "value"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("again"))
    )

    @F.pandas_udf("struct<text:string,kinds:array<string>>")
    def apply(texts: pd.Series, agains: pd.Series) -> pd.DataFrame:
        new, kinds = [], []
        for body, again in zip(texts, agains, strict=True):
            known = {(a["kind"], a["value"]): a["attempt"] for a in again} if again is not None else {}
            t, k = replaced(body, known, key) if body else (body, [])
            new.append(t)
            kinds.append(k)
        return pd.DataFrame({"text": pd.Series(new, dtype=object), "kinds": pd.Series(kinds, dtype=object)})

    numbered = packed(docs, row=row_number(docs))
    joined = numbered.join(settle(again), "row", "left")
    result = joined.select("doc", apply(F.col(f"doc.{text}").cast("string"), F.col("again")).alias("new"))
    return result.select("doc", F.col("new.text").alias("replaced"), F.col("new.kinds").alias("kinds"))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The documents with surrogates in their texts; the columns are those of ``docs``."""
    rows = replace(docs, text, key)
    return rows.select(
        *[(F.col("replaced") if n == text else F.col("doc").getField(n)).alias(n) for n in docs.columns]
    )
