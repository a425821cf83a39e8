"""PII: detected entities get keyed, type-consistent surrogates.

Detection works on whole texts: e-mail and IPv4 addresses, phone, card (Luhn), social security and bank account (mod 97)
numbers, secrets (cloud keys, assigned passwords and tokens), and names, capitalised or in capitals: after a title, after
words that announce a name ("my name is"), or a known given name with a following name; then its parts wherever they stand in
the text. A number next to other digits is found in whole groups. An occurrence is reduced to a type and a normal form
(digits of a number, lower-cased e-mail, one lower-cased part of a name), so that differently written mentions of one entity
share a surrogate: coreference. A part of a name is one entity, as a given name and as a family name; its gender is what
most of its mentions in all documents say.

Surrogates come from HMAC-SHA256 under the caller's key over type, normal form and attempt, and keep what the type asks
for: digit counts, separators, country code and class of a number, a valid check digit, letter case and script; given
names keep their gender, and every name its script. A surrogate is accepted only if no entity of the corpus has it as its
own normal form and no other entity holds it; else the next attempt is made. That check is a join over all distinct
entities, in rounds, so distinct entities stay distinct. Later attempts draw from wider spaces, so that the rounds end however
many entities share a format: from the 4th on a private address leaves its network, a number keeps less of its prefix;
from the 16th on a surrogate may be longer than the original.

Null texts stay null; texts without entities pass unchanged; an empty table gives an empty result; repeated rows change alike;
extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_bytes, cut, keyed, release, slices, small_or_shuffled, table

# Titles by gender, and given names by script and gender. Surrogates are drawn from the names.
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"], "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа"], "": ["Dr", "Prof", "Professor"]}
GIVEN = {
    ("LATIN", "m"): [
        "Adam", "Ahmed", "Albert", "Alexander", "Ali", "Andrew", "Anton", "Antonio", "Arthur", "Benjamin", "Carl", "Carlos", "Charles", "Christian", "Daniel", "David", "Diego", "Edward", "Felix", "Fernando", "Francisco", "François", "Frank", "George", "Giovanni", "Hans", "Hassan", "Henry",
        "Hiroshi", "Ibrahim", "Ivan", "Jacob", "James", "Jean", "John", "Jorge", "Joseph", "José", "Juan", "Julian", "Jürgen", "Karl", "Kenji", "Klaus", "Leon", "Louis", "Luca", "Lucas", "Luis", "Marco", "Mark", "Martin", "Michael", "Miguel", "Mohammed", "Oliver", "Omar", "Oscar",
        "Pablo", "Paul", "Pedro", "Peter", "Philip", "Pierre", "Rahul", "Robert", "Samuel", "Simon", "Stefan", "Stephen", "Thomas", "Victor", "Walter", "Wei", "William", "Wolfgang", "Yusuf",
    ],
    ("LATIN", "f"): [
        "Agnes", "Aisha", "Alice", "Amelia", "Ana", "Anna", "Barbara", "Beatrice", "Carla", "Carmen", "Caroline", "Charlotte", "Chiara", "Claire", "Clara", "Diana", "Elena", "Elizabeth", "Emma", "Eva", "Fatima", "Florence", "Francesca", "Giulia", "Grace", "Greta", "Hannah", "Helen",
        "Hélène", "Ida", "Ingrid", "Irene", "Isabel", "Jane", "Julia", "Karen", "Katharina", "Laura", "Layla", "Lily", "Linda", "Louise", "Lucy", "Lucía", "Margaret", "Maria", "María", "Martha", "Mary", "Mei", "Nadia", "Nina", "Olga", "Olivia", "Priya", "Rose", "Ruth", "Sarah",
        "Sofía", "Sophia", "Susan", "Teresa", "Victoria", "Yuki", "Zoë",
    ],
    ("CYRILLIC", "m"): ["Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Игорь", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
    ("CYRILLIC", "f"): ["Анна", "Вера", "Галина", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Надежда", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("GREEK", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("GREEK", "f"): ["Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
}
# Words that announce a name.
CUES = ["my name is", "name:", "signed by", "signed,", "regards,", "sincerely,", "attn:", "author:", "patient:", "customer:", "employee:", "contact:"]
#: Syllables from which family names are built, by script.
SYLLABLES = {"LATIN": ["ba", "den", "fel", "gar", "hol", "ker", "lan", "mor", "nel", "par", "ros", "sel", "tan", "ver", "wil", "zor"], "CYRILLIC": ["ба", "ве", "го", "да", "за", "ки", "ле", "ма", "но", "ро", "са", "то"], "GREEK": ["αν", "βα", "γε", "δη", "κα", "λο", "μα", "νι", "πα", "ρο", "σε", "το"]}
#: How built names end, by script and gender.
ENDINGS = {("LATIN", "m"): "o", ("LATIN", "f"): "a", ("CYRILLIC", "m"): "н", ("CYRILLIC", "f"): "а", ("GREEK", "m"): "ος", ("GREEK", "f"): "α"}
_GENDER = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
_TITLE_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}


def _any_of(words: list[str]) -> str:
    """A pattern of alternatives, the longest first, by first letter, so that most places fail at once."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ")"


_BIG, _SMALL = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ", "a-zà-öø-ÿα-ωάέήίόύώςа-яё"
_CAP = rf"(?:[OD]['’]|Ma?c)?[{_BIG}][{_SMALL}]+(?:[-'’][{_BIG}][{_SMALL}]+)?"
_UP = rf"[{_BIG}]{{2,}}(?:[-'’][{_BIG}]{{2,}})?"
_PART = rf"(?:{_CAP}|{_UP})"
_TITLE = _any_of([x for t in (t for ts in TITLES.values() for t in ts) for x in (t, t.upper())])
_NAME = _any_of([n for names in GIVEN.values() for n in names])
_UP_NAME = _any_of([n.upper() for names in GIVEN.values() for n in names])
_CUE = _any_of([x for c in CUES for x in (c, c.capitalize(), c.title(), c.upper())])
ENTITY = re.compile(
    rf"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}})
    |(?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])
       |(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)["']?\s{{0,3}}[=:]\s{{0,3}}["']?)(?P<value>[A-Za-z0-9+/_.~-]{{6,}}))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d\d(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?!\.?\d))
    |(?P<card>(?<![\d+])(?!\d{{1,2}}[ -])\d(?:[ -]?\d){{12,18}}(?!\d))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}(?!\d)|(?<![\w-])(?:\(\d{{3}}\)\ ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?![\d-]))
    |(?P<name>\b(?:(?P<title>{_TITLE})(?:\.\ ?|\ )(?P<titled>{_PART}(?:\ {_PART})?)|(?P<known>{_NAME}\ {_CAP}|{_UP_NAME}\ {_UP})|{_CUE}\ (?P<told>{_PART}(?:\ {_PART}){{1,2}}))(?!\w))""",
    re.X,
)
KINDS = ("email", "secret", "iban", "ip", "card", "ssn", "phone", "name")
_LINES = ENTITY.pattern.split("\n    |")
#: Each number's pattern alone, to try where the first that matched isn't valid.
ALONE = {k: re.compile(x, re.X) for k in KINDS[2:7] for x in _LINES if x.lstrip().startswith(f"(?P<{k}>")}
_GAP = re.compile(r"[ .-]")
_WORD = re.compile(rf"(?<!\w){_PART}(?!\w)")
#: What a text without any entity lacks, told at a fraction of the search's cost: signs, runs of digits, or words.
_RUN = re.compile(r"\d[\d .()-]{5}|[A-Z]{2}\d\d")
_SIGNS = ("@", "AKIA", "ASIA")
_KEYS = ("passw", "pwd", "token", "secret", "api")
_WORDS = re.compile(r"\w+")
_TELLING = {w for c in CUES for w in _WORDS.findall(c) if w not in ("my", "is", "by")}
_TELLING |= {f(w) for w in _TELLING for f in (str.capitalize, str.upper)} | {f(w) for w in [*(t for ts in TITLES.values() for t in ts), *(n for names in GIVEN.values() for n in names)] for f in (str, str.upper)}


def hinted(text: str) -> bool:
    """Whether the text can have an entity."""
    if any(x in text for x in _SIGNS) or _RUN.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _KEYS) or not _TELLING.isdisjoint(_WORDS.findall(text))


_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split(" ")[0]


def _valid(kind: str, s: str) -> bool:
    digits = "".join(_DIGIT.findall(s))
    if kind == "iban":
        return _mod97(s.replace(" ", "")) == 1
    if kind == "ip":
        return all(int(x) < 256 for x in s.split("."))
    if kind == "card":
        return luhn(digits) and bool(digits.strip("0"))
    return kind != "phone" or 9 <= len(digits) <= 15


def _end(kind: str, text: str, start: int) -> int:
    """Where a valid number of this kind that starts here ends, or 0: a group of digits is whole or not part of it.

    It is the longest run of groups that is valid, but a run ends where another valid entity follows within the match.
    """
    found = ALONE[kind].match(text, start)
    if not found:
        return 0
    if kind in ("ip", "ssn"):
        return found.end() if _valid(kind, found.group()) else 0
    ends = [start + g.start() for g in _GAP.finditer(found.group())]
    good = [e for e in [*ends, found.end()] if _valid(kind, text[start:e]) and ALONE[kind].fullmatch(text, start, e)]
    for e in good[:-1] if kind != "iban" else ():
        if any((x := ALONE[k].match(text, e + 1)) and _valid(k, x.group()) for k in ("ip", "card", "ssn", "phone")):
            return e
    return good[-1] if good else 0


def _matches(text: str) -> Iterator[tuple[str, re.Match, int]]:
    """(kind, match, end) of each valid entity; where a number isn't valid the other kinds are tried, then the next character."""
    at = 0
    while m := ENTITY.search(text, at):
        kind, end = next(k for k in KINDS if m.group(k) is not None), m.end()
        if kind in ALONE:
            kind, end = next(((k, e) for k in [kind, *(k for k in ALONE if k != kind)] if (e := _end(k, text, m.start()))), (kind, 0))
        if end:
            yield kind, m, end
        at = end or m.start() + 1


def find(text: str, genders: dict[str, str] | None = None) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity, left to right; a name gives one for each of its parts.

    genders: gets what a name's title or its own entry says of its given part.
    """
    if not hinted(text):
        return
    found = []
    names = set()
    for kind, m, end in _matches(text):
        s = text[m.start() : end]
        digits = "".join(_DIGIT.findall(s))
        if kind == "email":
            found.append((m.start(), end, kind, s.lower()))
        elif kind == "secret":
            a, b = m.span("value") if m.group("value") else m.span()
            found.append((a, b, kind, text[a:b]))
        elif kind == "iban":
            found.append((m.start(), end, kind, s.replace(" ", "")))
        elif kind == "ip":
            found.append((m.start(), end, kind, ".".join(str(int(x)) for x in s.split("."))))
        elif kind in ("card", "ssn"):
            found.append((m.start(), end, kind, digits))
        elif kind == "phone":
            # a national number and the same with country code 1 are one entity
            found.append((m.start(), end, kind, digits[1:] if s[0] == "+" and digits[0] == "1" and len(digits) == 11 else digits if s[0] != "+" else "+" + digits))
        else:
            of = next(g for g in ("titled", "known", "told") if m.group(g))
            at, parts = m.start(of), m.group(of).split(" ")
            for i, part in enumerate(parts):
                normal = part.lower()
                found.append((at, at + len(part), kind, normal))
                names.add(normal)
                if genders is not None and i == 0 and len(parts) > 1:
                    gender = _GENDER.get(normal) or _TITLE_GENDER.get((m.group("title") or "").lower(), "")
                    genders[normal] = genders.get(normal) or gender
                at += len(part) + 1
    if names:  # a part of a name that stands alone elsewhere in the text is the same person's
        taken = iter([*found, (len(text), len(text), "", "")])
        a, b, *_ = next(taken)
        more = []
        for w in _WORD.finditer(text):
            while b <= w.start():
                a, b, *_ = next(taken)
            if w.end() <= a and w.group().lower() in names:
                more.append((w.start(), w.end(), "name", w.group().lower()))
        found = sorted(found + more)
    yield from found


class Stream:
    """Numbers from HMAC-SHA256 in counter mode."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.n, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.pool = int.from_bytes(hmac.digest(self.key, self.what + b"\x1f%d" % self.n, "sha256"), "big")
            self.n, self.left = self.n + 1, 256
        self.pool, out = divmod(self.pool, n)
        self.left -= n.bit_length()
        return out

    def like(self, c: str) -> str:
        if "0" <= c <= "9":
            return str(self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        return c

    def hexlike(self, s: str) -> str:
        if re.fullmatch("[0-9a-f]+", s):
            return "".join("0123456789abcdef"[self.below(16)] for _ in s)
        return "".join(map(self.like, s))


def surrogate(key: bytes, kind: str, normal: str, attempt: int, gender: str = "") -> str:
    """A normal form of the same kind; the same for the same arguments. Later attempts draw from wider spaces."""
    r = Stream(key, kind, normal, attempt)
    longer = max(0, attempt - 8) // 8
    if kind == "email":
        local, _, domain = normal.partition("@")
        host, _, end = domain.rpartition(".")
        return "".join(map(r.like, local + "a" * longer)) + "@" + "".join(map(r.like, host)) + "." + end
    if kind == "secret":
        keep = 4 if normal[:4] in ("AKIA", "ASIA") else 0
        return normal[:keep] + r.hexlike(normal[keep:]) + "".join(map(r.like, "0" * longer))
    if kind == "iban":
        body = "".join(map(r.like, normal[4:] + "0" * longer))
        check = 98 - _mod97(normal[:2] + "00" + body)
        return f"{normal[:2]}{check:02d}{body}"
    if kind == "ip":
        parts = [int(x) for x in normal.split(".")]
        keep = max(0, 2 - attempt // 4) if ipaddress.ip_address(normal).is_private else 0  # a private address stays in its network
        sizes = [(1, 10), (10, 100), (100, 256)] if attempt < 4 else [(0, 256)] * 3
        octets = [p if i < keep else (lambda a, b: a + r.below(b - a))(*sizes[len(str(p)) - 1]) for i, p in enumerate(parts)]
        return ".".join(map(str, octets + [r.below(256) for _ in range(attempt // 32)]))
    if kind == "card":
        body = (normal[0] if attempt < 8 else r.like("0")) + "".join(map(r.like, normal[1:-1] + "0" * longer))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ssn":
        return f"{1 + r.below(665 if attempt < 4 else 999):03d}{1 + r.below(99):02d}{1 + r.below(9999):04d}" + "".join(map(r.like, "0" * longer))
    if kind == "phone":
        keep = (3 if attempt < 4 else 2) if normal[0] == "+" else 0
        rest = normal[keep:] + "0" * longer
        if not keep and len(rest) == 10:  # area code and exchange don't begin with 0 or 1
            return f"{2 + r.below(8)}{r.below(100):02d}{2 + r.below(8)}{r.below(100):02d}{r.below(10000):04d}"
        return normal[:keep] + "".join(map(r.like, rest))
    letters = script(normal)
    names = GIVEN.get((letters, gender), []) if gender else []
    if names and attempt < 4:
        return names[r.below(len(names))].lower()
    syllables = SYLLABLES.get(letters, SYLLABLES["LATIN"])
    return "".join(syllables[r.below(len(syllables))] for _ in range(2 + (attempt + 1) // 2)) + ENDINGS.get((letters, gender), "")


def render(found: str, kind: str, normal: str, new: str) -> str:
    """new, written the way this occurrence is."""
    if kind == "name":
        return new.upper() if found.isupper() and len(found) > 1 else new.capitalize()
    if kind in ("iban", "card", "ssn", "phone"):
        plain = new.lstrip("+")
        here = sum(c.isalnum() for c in found)
        prefix = "".join(_DIGIT.findall(found))[: here - len(normal.lstrip("+"))] if here > len(normal.lstrip("+")) else ""
        chars = iter(prefix + plain)
        return "".join(next(chars, "") if c.isalnum() else c for c in found) + "".join(chars)
    if kind == "email":
        out = [n.upper() if c.isupper() else n for c, n in zip(found, new, strict=False)]
        return "".join(out) + new[len(out) :]
    return new


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, _qs_th, kind, normal, gender): the distinct entities of each row that has any."""
    schema = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("kind", pa.string()), ("normal", pa.string()), ("gender", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, h, t in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("_qs_th").to_pylist(), as_bytes(part.column("text")), strict=True):
                    genders: dict[str, str] = {}
                    out += [(d, h, k, n, genders.get(n, "") if k == "name" else "") for k, n in dict.fromkeys((k, n) for _, _, k, n in list(find(t.decode(), genders)))]
                yield table(out, schema)

    return keyed(docs).mapInArrow(run, "doc_id long, _qs_th long, kind string, normal string, gender string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, surrogate) for the distinct entities in found, no surrogate twice and none that is an entity."""

    @F.pandas_udf("string")
    def propose(kind: pd.Series, normal: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, a, g) for k, n, a, g in zip(kind, normal, attempt, gender, strict=True)], dtype=object)

    votes = [F.count_if(F.col("gender") == g) for g in ("m", "f")]
    gender = F.when(votes[0] > votes[1], "m").when(votes[1] > votes[0], "f").otherwise("")
    todo = cut(found.groupBy("kind", "normal").agg(gender.alias("gender")))
    # what is taken: the entities themselves, and what each round has given away
    taken = todo.select("kind", F.col("normal").alias("surrogate"))
    done, attempt, left = None, 0, todo.count()
    while left:
        tried = cut(todo.withColumn("surrogate", propose("kind", "normal", F.lit(attempt), "gender")))
        wanted = tried.select("kind", "surrogate").distinct()
        # the few that are left to try are sent to what is taken, not the other way round
        clash = cut(taken.join(F.broadcast(wanted) if left * 200 <= BROADCAST_BYTES else wanted, ["kind", "surrogate"], "left_semi").distinct())
        free = tried.join(small_or_shuffled(clash, 100), ["kind", "surrogate"], "left_anti")
        won = cut(free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal")))
        taken = taken.union(won.select("kind", "surrogate"))
        done = won if done is None else done.unionByName(won)
        todo = cut(todo.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        left, attempt = todo.count(), attempt + 1
    return done.select("kind", "normal", "surrogate") if done is not None else found.select("kind", "normal", F.lit("").alias("surrogate")).limit(0)


def scrub(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in the text, and _qs_entities: how many occurrences each text had."""
    found = cut(entities(docs))
    mapped = found.join(assign(found, key), ["kind", "normal"])
    each = mapped.groupBy("doc_id", "_qs_th").agg(F.collect_set(F.struct("kind", "normal", "surrogate")).alias("_qs_map"))
    each = cut(each.withColumnRenamed("doc_id", "_qs_id"))

    @F.pandas_udf("text string, n int")
    def replaced(text: pd.Series, mapping: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for t, m in zip(text, mapping, strict=True):
            if m is None or t is None:
                texts.append(t)
                counts.append(0)
                continue
            new = {(x["kind"], x["normal"]): x["surrogate"] for x in m}
            out, at, n = [], 0, 0
            for a, b, k, s in find(t):
                out += [t[at:a], render(t[a:b], k, s, new[k, s])]
                at, n = b, n + 1
            texts.append("".join(out) + t[at:])
            counts.append(n)
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n": counts})

    size = each.agg(F.sum(F.octet_length(F.to_json("_qs_map"))).alias("s")).first()["s"] or 0
    side = small_or_shuffled(each, 64 + size // max(1, each.count()))
    release(docs.sparkSession)
    joined = docs.join(side, docs["doc_id"].eqNullSafe(F.col("_qs_id")) & (F.xxhash64(docs["text"]) == F.col("_qs_th")), "left")
    changed = joined.withColumn("_qs_new", replaced("text", "_qs_map"))
    return changed.select(*[F.col("_qs_new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col("_qs_new.n").alias("_qs_entities"))


def report(docs: DataFrame, key: bytes = b"quarrystone") -> DataFrame:
    """doc_id, text with surrogates, n_entities, text_sha256."""
    out = scrub(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.col("_qs_entities").cast("long").alias("n_entities"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
