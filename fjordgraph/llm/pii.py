"""Personal data replaced by keyed surrogates of the same type.

Detected entities are replaced by values of the same type, gender, script and
format: e-mail addresses, phone numbers (international, and national with a
leading zero), IPv4, IPv6 and MAC addresses, card and account numbers, IBANs,
national id numbers, secrets after a keyword, and names after a title, a label or
a phrase that introduces one, or with a known given name or surname. Detection of
names rests on these cues; a name without any of them is not found. A surrogate
is the entity's image under a keyed permutation of all values of its form, so it
needs no table shared between tasks: the same entity always gets the same
surrogate (coreference, over the whole corpus), two entities never get the same
one (distinctness), and none stays itself. Card numbers and IBANs have right
check digits if, and only if, the originals have. Given names that are listed permute
within the list of their gender and script. Other names are numbered by their letters,
the number is permuted among those of equal length and spelt in syllables of the same
script: so many names need more letters than they had. Given names get the ending of
their gender, which their own ending tells, or else the title before them, and surnames
one of their own. Each document is checked for collisions: if two entities were about
to share a surrogate, or one to stay itself, the later one moves on along its
permutation. :func:`collisions` checks a whole table.

Every word of a found name is followed through its text where it stands as a name: with
the name's own capitals or in capitals throughout, unless it opens a sentence and is an
ordinary word elsewhere in the text. In small letters it is followed where another word
of the name stands beside it, where marks set it apart on both sides (not commas alone)
and the text does not use it as a word, or if it is a listed surname.

The key is the caller's; :func:`environment_key` reads it from the environment, and
without one there is an error: a key of chance would break coreference between runs.

Null texts stay null and have no entities; empty texts stay empty. Texts are
searched whole. Repeated rows are replaced alike, an empty table stays empty, and
columns other than the text stay as they are, but for those that
:func:`anonymise` adds.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


RESULT = "text string, n_entities int, n_distinct int, n_surrogates int, entities array<struct<kind: string, original: string, surrogate: string>>"
ROUNDS = 6

# Common given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Anne Barbara Camille Carla Carmen Charlotte Claire Clara Elena Elisabeth Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucia Margaret Maria Marie Marta Mary Monika Nancy Nicole Olivia Patricia Paula Sabine Sandra Sarah Sofia Sophie Susan Ursula Victoria",
    ("m", "latin"): "Alexander Andreas Anthony Antonio Carlos Charles Christian Daniel David Diego Edward Felix Fernando Frank François George Hans Henry Hugo Jack Jacques James Javier Jean Johann John Jorge José Joseph Juan Karl Klaus Lucas Luis Manuel Mark Martin Michael Miguel Nicolas Oliver Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas William",
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия",
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей",
    ("f", "greek"): "Αγγελική Άννα Βασιλική Ελένη Ευαγγελία Ιωάννα Κατερίνα Μαρία Σοφία",
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος Παναγιώτης Σπύρος",
}
# Titles by gender.
TITLES = {"f": "Mrs Ms Miss Madam Frau Mme Mlle Madame Señora Sra Srta", "m": "Mr Sir Herr Monsieur Señor Sr", "": "Dr Prof"}
# Common surnames that are no common words of their languages.
SURNAMES = "Smith Johnson Williams Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Perez Thompson Harris Robinson Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dubois Durand Lefebvre Moreau Rossi Russo Ferrari Bianchi Wang Zhang Liu Chen Yang Huang Zhao Zhou Kim Nguyen Tran Singh Kumar Sharma Patel Khan Ivanov Petrov Silva Santos"
# Those of them that are words of another of these languages.
WORDS_TOO = "Bianchi Rossi Russo Santos Silva"
# Capitalised words before a surname that are no given names.
NO_GIVEN = "The This That These Those And But For With From Our Your Their His Her Its When While After Before Dear Hello Der Die Das Und Les Des Los Las Del"
# Phrases and labels that introduce a name.
INTRODUCTIONS = ["my name is", "My name is", "I am called", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo"]
# Country calling codes of one and two digits; all others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# Letters that stand for each other, by script and kind.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøœùúûü", "çñßýÿðþ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ"]

# How given names that no list has tell their gender.
ENDINGS = {"f": "trude hilde linde garde gunde ette elle ine ia ina lyn een anne".split(), "m": "gang fried bert hard wolf mar ald rich win bald ward ius ian".split()}
# Syllables of made-up names, onsets and vowels, then the endings of given
# names (female, male) and of surnames; plain ones and those for names with accents.
SYLLABLES = {
    "latin": ("b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p ph pl pr r s sl sp st t th tr v w z sh sk", "a e i o u ai au ei ia eo", ("na", "no", "nt"), ("ná", "nó", "ñt")),
    "cyrillic": ("б бл бр в вл г гл гр д др ж з к кл кр л м н п пл пр р с сл ст т тр ф х ц ч ш", "а е и о у я ю", ("на", "н", "нов"), ("на", "н", "нов")),
    "greek": ("β γ γρ δ δρ ζ θ κ κλ κρ λ μ ν ξ π πλ πρ ρ σ στ τ τρ φ χ ψ", "α ε η ι ο υ ω", ("να", "νος", "νης"), ("νά", "νός", "νής")),
}

_LETTER = r"[^\W\d_]"
_CAP = rf"(?:[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]{_LETTER}+(?:[-'’]{_LETTER}+)*)"
_NAMES = sorted({n for v in GIVEN.values() for n in v.split()}, key=lambda n: (-len(n), n))
_TITLES = sorted({t for v in TITLES.values() for t in v.split()}, key=lambda t: (-len(t), t))
_LABELS = [f"{w}:" for x in ("name", "contact", "author", "patient", "customer") for w in (x, x.title(), x.upper())]
_SURNAMES = sorted(SURNAMES.split(), key=lambda n: (-len(n), n))
#: In every keyword of a secret, whatever its case; before a secret that needs none.
_WORDS, _ISSUERS = ("token", "secret", "passw", "pwd", "key", "auth"), ("sk-", "xox", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_LISTED = {n.lower() for n in _NAMES}
_HEX6 = r"[0-9A-Fa-f]{1,4}"

#: (kind, pattern, group of the entity), the first that matches takes the span.
PATTERNS: list[tuple[str, re.Pattern, int]] = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"), 0),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;\0]{6,})"), 1),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})\b"), 0),
    ("mac", re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"), 0),
    ("ip", re.compile(r"(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"), 0),
    ("ip6", re.compile(rf"(?<![\w:.])(?:(?:{_HEX6}:){{7}}{_HEX6}|(?:{_HEX6}(?::{_HEX6}){{0,6}})?::(?:{_HEX6}(?::{_HEX6}){{0,6}})?)(?![\w:])"), 0),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("id", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0),
    ("card", re.compile(r"(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<!\d)(?<!\d\.)\d{13,19}(?!\d)"), 0),
    ("phone", re.compile(r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\w+.,/-])(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])(?=(?:[ -]?\d){6,9}(?!\d))\d{3,9}(?:[ -]\d{2,5}){0,2}(?![\w-]|[.,]\d)"), 0),
]
_GIVEN_OR = rf"(?!(?:{'|'.join(NO_GIVEN.split())})\b){_CAP}"
_NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(_TITLES)})\b\.?\s+(?P<after>{_CAP}(?:[ ]{_CAP}){{0,2}})"
    rf"|(?:{'|'.join(_LABELS + INTRODUCTIONS)})\s*(?P<label>{_CAP}(?:[ ]{_CAP}){{1,2}})"
    rf"|(?P<known>(?:{'|'.join(_NAMES)})[ ]{_CAP}))"
)
_FAMILY = re.compile(rf"(?:{'|'.join(_SURNAMES)})[ ]{_GIVEN_OR}")
#: A surname after a name; matched from the surname's start backwards.
_BEFORE = re.compile(rf"{_GIVEN_OR}(?:[ ]{_CAP})?[ ]$")
_DIGIT = re.compile(r"\d")
#: Which of :data:`ALPHABETS` make a script.
_SCRIPTS = {"latin": "".join(ALPHABETS[:4]), "cyrillic": "".join(ALPHABETS[4:6]), "greek": "".join(ALPHABETS[6:])}
_PLAIN = "abcdefghijklmnopqrstuvwxyz"
_FAMILIES = {n.lower() for n in _SURNAMES} - set(WORDS_TOO.lower().split())
_GENDER = {t: g for g, ts in TITLES.items() for t in ts.split()}


def _keywords() -> ahocorasick.Automaton:
    """Finds in one pass wherever a name or an issuer's secret may begin."""
    found = ahocorasick.Automaton()
    for word in _ISSUERS:
        found.add_word(word, ("secret", len(word)))
    for word in _TITLES + _LABELS + INTRODUCTIONS + [f"{n} " for n in _NAMES]:
        found.add_word(word, ("name", len(word)))
    for word in _SURNAMES:
        found.add_word(word, ("family", len(word)))
    found.make_automaton()
    return found


_KEYWORDS = _keywords()


class Permutation:
    """Keyed permutations of ``range(n)`` without fixed points."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: bytes, r: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = b""
        for block in range(-(-size // 64)):
            seed = tag + bytes([r, block & 255]) + x.to_bytes(size, "little")
            out += hashlib.blake2b(seed, key=self.key).digest()
        return int.from_bytes(out[:size], "little") & ((1 << bits) - 1)

    def _mix(self, tag: bytes, n: int, x: int, back: bool) -> int:
        bits = max(1, (n - 1).bit_length() + 1 >> 1)
        mask = (1 << bits) - 1
        while True:  # walk the cycle until it is within range again
            a, b = x >> bits, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ self._round(tag, r, a, bits), a) if back else (b, a ^ self._round(tag, r, b, bits))
            x = a << bits | b
            if x < n:
                return x

    def __call__(self, tag: str, n: int, x: int) -> int:
        """Conjugate of a rotation: a permutation that moves everything."""
        if n < 2:
            return x
        t = hashlib.blake2b(f"{tag}/{n}".encode(), digest_size=16).digest()
        step = 1 + self._round(t, 255, 0, 64) % (n - 1)
        return self._mix(t, n, (self._mix(t, n, x, False) + step) % n, True)


def _alphabet(c: str) -> str | None:
    if c.isdigit() and c.isascii():
        return "0123456789"
    return next((a for a in ALPHABETS if c in a), None)


class Surrogates:
    """Surrogates of one key; remembers nothing between entities."""

    def __init__(self, key: str):
        self.permute = Permutation(key.encode())
        self.given = {(g, s): names.split() for (g, s), names in GIVEN.items()}
        self.where = {n.lower(): (k, i) for k, names in self.given.items() for i, n in enumerate(names)}

    def form(self, kind: str, text: str, alphabet: Callable[[str], str | None] = _alphabet) -> str:
        """Characters of each alphabet change places; all others stay."""
        slots = [(i, a) for i, c in enumerate(text) if (a := alphabet(c))]
        if not slots:
            return text
        x, n = 0, 1
        for i, a in slots:
            x, n = x * len(a) + a.index(text[i]), n * len(a)
        shape = "".join(a[0] if (a := alphabet(c)) else c for c in text)
        x = self.permute(f"{kind}/{shape}", n, x)
        out = list(text)
        for i, a in reversed(slots):
            x, k = divmod(x, len(a))
            out[i] = a[k]
        return "".join(out)

    @staticmethod
    def _cased(like: str, text: str) -> str:
        if len(like) != len(text):
            return text.upper() if like.isupper() and len(like) > 1 else text[:1].upper() + text[1:] if like[:1].isupper() else text
        return "".join(c.upper() if l.isupper() and len(c.upper()) == 1 else c for l, c in zip(like, text, strict=True))

    def digits(self, kind: str, text: str, keep: int = 0) -> str:
        """Digits change but for the first ``keep``; separators stay, and do
        not count: one number in two notations has one surrogate."""
        ds = [c for c in text if c.isdigit()]
        new = iter("".join(ds[:keep]) + self.form(kind + "".join(ds[:keep]), "".join(ds[keep:])))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def hexes(self, kind: str, text: str) -> str:
        return self._cased(text, self.form(kind, text.lower(), lambda c: "0123456789abcdef" if c in "0123456789abcdef" else None))

    def email(self, text: str) -> str:
        local, domain = text.rsplit("@", 1)
        labels = domain.lower().split(".")
        host = [self.form(f"host{k}", x) for k, x in enumerate(labels[:-2])] + labels[-2:]
        if labels[-2] != "example":  # names reserved for documentation stay
            host[-2] = self.form("host", labels[-2])
        return self._cased(local, self.form("local@" + domain.lower(), local.lower())) + "@" + ".".join(host)

    def card(self, text: str) -> str:
        """All digits change; the last keeps its distance to the check digit."""
        ds = [int(c) for c in text if c.isdigit()]
        body = self.form("card", "".join(map(str, ds[:-1])))
        last = (_luhn(body) + ds[-1] - _luhn("".join(map(str, ds[:-1])))) % 10
        new = iter(body + str(last))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def ip6(self, text: str) -> str:
        """Groups that are zero stay so, and the first; the notation is kept."""
        x = ipaddress.IPv6Address(text)
        groups = [int(g, 16) for g in x.exploded.split(":")]
        at = [k for k, g in enumerate(groups) if g and k]
        n, v = 1, 0
        for k in at:
            n, v = n * 65535, v * 65535 + groups[k] - 1
        v = self.permute(f"ip6/{groups[0]}/{at}", n, v)
        for k in reversed(at):
            v, g = divmod(v, 65535)
            groups[k] = g + 1
        y = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
        full = all(len(g) == 4 for g in text.split(":"))
        out = y.compressed if "::" in text else y.exploded if full else ":".join(f"{g:x}" for g in groups)
        return out.upper() if text.upper() == text else out

    def ip(self, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")

        def kind(v: int) -> str:
            a, b = v >> 24, v >> 16 & 255
            if a == 10 or a == 192 and b == 168 or a == 172 and 16 <= b < 32:
                return "private"
            return "loop" if a == 127 else "low" if a == 0 else "high" if a >= 224 else "public"

        y = self.permute("ip", 1 << 32, x)
        while kind(y) != kind(x):
            y = self.permute("ip", 1 << 32, y)
        if y == x:  # alone of its kind on the cycle
            return text
        return ".".join(map(str, y.to_bytes(4, "big")))

    def spelt(self, text: str, gender: str = "") -> str:
        """A name that no list has: the runs of letters of one script are spelt anew."""
        out, at, low = [], 0, text.lower()
        while at < len(low):
            script = next((x for x, letters in _SCRIPTS.items() if low[at] in letters), None)
            end = at + 1
            while script and end < len(low) and low[end] in _SCRIPTS[script]:
                end += 1
            out.append(self._run(low[at:end], script, gender) if script else low[at:end])
            at = end
        return self._cased(text, "".join(out))

    def _run(self, run: str, script: str, gender: str) -> str:
        plain = script == "latin" and all(c in _PLAIN for c in run)
        letters = _PLAIN if plain else _SCRIPTS[script]
        x = 0
        for c in run:
            x = x * len(letters) + letters.index(c)
        n = len(letters) ** len(run)
        # names of all lengths are numbered one after the other, so no two are spelt alike
        x = self.permute(f"name/{script}/{gender}/{len(run)}", n, x) + (n - 1) // (len(letters) - 1)
        onsets, vowels, ends, accented = SYLLABLES[script]
        onsets, vowels = onsets.split(), vowels.split()
        out = ""
        while True:
            x, k = divmod(x, len(onsets) * len(vowels))
            out = onsets[k // len(vowels)] + vowels[k % len(vowels)] + out
            if not x:
                break
            x -= 1
        end = (ends if plain or script != "latin" else accented)["fm".find(gender) if gender else 2]
        return out + ("l" if script == "latin" and out + end in _LISTED else "") + end

    def given_name(self, text: str, title: str = "") -> str:
        hit = self.where.get(text.lower())
        if hit is None:
            return self.spelt(text, self.gender(text) or title)
        (gender, script), i = hit
        names = self.given[gender, script]
        return self._cased(text, names[self.permute(f"given/{gender}/{script}", len(names), i)].lower())

    @staticmethod
    def gender(word: str) -> str:
        """What the ending of an unlisted name tells; surnames that are listed have none."""
        low = word.lower()
        if low in _FAMILIES:
            return ""
        return next((g for g, ends in ENDINGS.items() if len(low) > 5 and low.endswith(tuple(ends))), "")

    def name(self, text: str, titles: dict[str, str] | None = None) -> str:
        """Word by word; ``titles`` has what titles tell of words that do not tell it."""
        told = titles or {}
        return " ".join(self.given_name(w, told.get(w.lower(), "")) for w in text.split(" "))

    def step(self, kind: str, text: str, n: int, titles: dict[str, str] | None = None) -> str:
        """The ``n``-th image of an entity."""
        for _ in range(n):
            text = self.name(text, titles) if kind == "name" else self.of(kind, text)
        return text

    def of(self, kind: str, text: str) -> str:
        if kind == "email":
            return self.email(text)
        if kind == "ip":
            return self.ip(text)
        if kind == "ip6":
            return self.ip6(text)
        if kind == "card":
            return self.card(text)
        if kind == "id":
            return self.digits(kind, text)
        if kind == "phone":
            return self.digits(kind, text, _lead(text))
        if kind == "mac":
            return self.hexes(kind, text)
        if kind == "iban":
            return self._iban(text)
        if kind == "secret":
            return self.hexes(kind, text) if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", text) else self._secret(text)
        return self.name(text)

    def _iban(self, text: str) -> str:
        """Valid ones stay valid, and others do not become so."""
        old = text.replace(" ", "")
        kinds = lambda c: "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if _iban_rest(old) == 1:
            body = self.form("iban" + old[:2], old[4:], kinds)
            new = f"{old[:2]}{98 - _iban_rest(old[:2] + '00' + body):02d}{body}"
        else:
            new = old
            while True:
                new = old[:2] + self.form("no iban" + old[:2], new[2:], kinds)
                if _iban_rest(new) != 1:
                    break
        out = iter(new)
        return "".join(c if c == " " else next(out) for c in text)

    def _secret(self, text: str) -> str:
        """The prefix that tells the issuer stays."""
        lead = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-", text)
        if lead:
            return lead[0] + self._secret_body(lead[0], text[lead.end() :])
        return self._secret_body("", text)

    def _secret_body(self, lead: str, text: str) -> str:
        pools = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return self.form("secret" + lead, text, lambda c: next((p for p in pools if c in p), None))


def _luhn(body: str) -> int:
    """Check digit that belongs after ``body``."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_rest(iban: str) -> int:
    """1 for a valid IBAN, as ISO 7064 has it."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _lead(phone: str) -> int:
    """Digits of a phone number that stay: the country's code, or the zero."""
    ds = "".join(c for c in phone if c.isdigit())
    if not phone.startswith("+"):
        return int(ds.startswith("0"))
    return next((n for n in (1, 2) if ds[:n] in CALLING), 3)


def _is_ip6(text: str) -> bool:
    """An address with a digit that says more than its first group."""
    try:
        x = int(ipaddress.IPv6Address(text))
    except ValueError:
        return False
    return any(c.isdigit() for c in text) and bool(x & ((1 << 112) - 1)) and x > 0xFFFF


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of the entities, in order, not overlapping."""
    return _find(text)[0]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The characters before and after, blanks aside; empty at the text's ends."""
    while start and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return text[max(0, start - 1) : start], text[end : end + 1]


def _follow(text: str, left: str, names: list[str]) -> list[tuple[int, int]]:
    """Spans in ``left`` where words of ``names`` stand for the person again."""
    words: dict[str, set[str]] = {}
    beside: dict[str, set[str]] = {}
    for n in names:
        each = [w for w in n.split(" ") if w not in _GENDER]
        for w in each:
            words.setdefault(w.lower(), set()).add(w)
            beside.setdefault(w.lower(), set()).update(x.lower() for x in each if x != w)
    if not words:
        return []
    again = "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w))))
    found = list(re.finditer(rf"(?i)(?<![\w-])(?:{again})(?![\w-])", left))
    low = [m[0].lower() for m in found]
    joined = [False, *(b.start() == a.end() + 1 and text[a.end()] == " " and y in beside.get(x, ()) for a, b, x, y in zip(found, found[1:], low, low[1:], strict=False)), False]
    spans, ordinary, unsure = [], set(), []
    for i, (m, w) in enumerate(zip(found, low, strict=True)):
        if w not in words:
            continue
        if joined[i] or joined[i + 1] or w in _FAMILIES:
            spans.append(m.span())
        elif m[0] == w:  # in small letters
            a, b = _around(text, *m.span())
            if a.isalnum() or b.isalnum() or a == b == "," or (a + b).strip("'’-") != a + b:
                ordinary.add(w)
            else:
                unsure.append((m, w))
        elif m[0] in words[w] or m[0].isupper():
            unsure.append((m, w))
    for m, w in unsure:
        if w in ordinary:
            a, _ = _around(text, *m.span())
            opens = not a or a in ".!?:\"“„«¿¡(" or "\n" in text[text.rfind(a, 0, m.start()) : m.start()]
            shouted = m[0].isupper() and len(m[0]) > 1 and m[0] not in words[w]
            if m[0] == w or opens or shouted:
                continue
        spans.append(m.span())
    return spans


def _find(text: str) -> tuple[list[tuple[int, int, str]], dict[str, str]]:
    """:func:`find`'s spans, and the genders that titles give to words of names."""
    found: list[tuple[int, int, str]] = []
    titles: dict[str, str] = {}
    low = text.casefold()  # the patterns ignore case beyond ASCII, as in the Kelvin sign
    hints, starts, families = any(w in low for w in _WORDS), set(), []
    for end, (what, n) in _KEYWORDS.iter(text):
        if what == "secret":
            hints = True
        elif what == "name":
            starts.add(end + 1 - n)
        elif not text[end + 1 : end + 2].isalpha() and not text[end - n : end + 1 - n].isalpha():
            families.append((end + 1 - n, end + 1))
    digits, at_sign = _DIGIT.search(text) is not None, "@" in text

    def take(what: str, kind: str, spans: list[tuple[int, int]]) -> str:
        """Note the spans and blank them, so that later patterns match beside."""
        for a, b in spans:
            found.append((a, b, kind))
            what = what[:a] + "\0" * (b - a) + what[b:]
        return what

    left = text
    for kind, pattern, group in PATTERNS:
        if at_sign if kind == "email" else hints if kind == "secret" else digits or kind == "mac" and text.count(":") + text.count("-") >= 5:
            left = take(left, kind, [m.span(group) for m in pattern.finditer(left) if kind != "ip6" or _is_ip6(m[0])])
    names = []

    def name(span: tuple[int, int]) -> None:
        nonlocal left
        if "\0" not in left[slice(*span)]:
            names.append(left[slice(*span)])
            left = take(left, "name", [span])

    # the surest cues first; a surname ends a name rather than begins one
    for start in sorted(starts):
        if (m := _NAME.match(left, start)) is not None:
            name(m.span(next(g for g in ("after", "label", "known") if m[g])))
            first, _, rest = (m["after"] or "").partition(" ")
            if rest and first not in _GENDER and (g := _GENDER[m["title"]]):
                w = first.lower()
                titles[w] = g if titles.get(w, g) == g else ""  # none, if titles differ
    for start, end in families:
        back = start
        for _ in range(3 if left[start - 1 : start] == " " else 0):
            back = left.rfind(" ", 0, max(back, 0))
        before = _BEFORE.search(left, back + 1, start) if back < start else None
        if before and (before.start() == 0 or not left[before.start() - 1].isalpha()):
            name((before.start(), end))
    for start, _ in families:
        if (m := _FAMILY.match(left, start)) is not None:
            name(m.span())
    take(left, "name", _follow(text, left, names))
    return sorted(found), titles


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("phone", "card", "id"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind == "secret" else text.lower()


def replace(text: str | None, s: Surrogates) -> tuple:
    """(new text, entities, distinct ones, distinct surrogates, pairs)."""
    if not text:
        return text, 0, 0, 0, []
    spans, titles = _find(text)
    if not spans:
        return text, 0, 0, 0, []
    old = [text[a:b] for a, b, _ in spans]
    names = [(kind, canonical(kind, x)) for (_, _, kind), x in zip(spans, old, strict=True)]
    steps = _apart(names, old, s, titles)
    out, at, seen, pairs = [], 0, {}, []
    for (a, b, kind), x, name in zip(spans, old, names, strict=True):
        new = s.step(kind, x, steps.get(name, 1), titles)
        seen[name] = canonical(kind, new)
        pairs.append({"kind": kind, "original": x, "surrogate": new})
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    return "".join(out), len(spans), len(seen), len({(k, v) for (k, _), v in seen.items()}), pairs


def _apart(names: list[tuple[str, str]], old: list[str], s: Surrogates, titles: dict[str, str]) -> dict[tuple[str, str], int]:
    """Steps beyond the first that entities take to stay apart in a document."""
    taken: dict[tuple[str, str], tuple[str, str]] = {}
    steps = {}
    for name, x in zip(names, old, strict=True):
        kind = name[0]
        if name in steps:
            continue
        for n in range(1, 50):
            new = kind, canonical(kind, s.step(kind, x, n, titles))
            if taken.get(new, name) == name and new != name:
                break
        taken[new] = name
        steps[name] = n
    return {k: n for k, n in steps.items() if n > 1}


def environment_key(name: str = "FJORDGRAPH_PII_KEY", otherwise: str | None = None) -> str:
    """The key in that variable of the driver's environment. Without one it is
    ``otherwise``, or an error: runs under different keys do not agree."""
    key = os.environ.get(name) or otherwise
    if not key:
        raise ValueError(f"set {name} to the key of the surrogates")
    return key


def surrogate(spark: SparkSession, text: Column, key: str) -> Column:
    """Text -> ``struct`` of ``RESULT``."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Surrogates(key)
        names = ["text", "n_entities", "n_distinct", "n_surrogates", "entities"]
        for texts in batches:
            yield pd.DataFrame([replace(x, s) for x in texts], columns=names)

    return run(text)


def anonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents with ``text`` replaced; ``n_entities``, ``n_distinct``,
    ``n_surrogates`` and ``entities`` added (replacing columns of these names)."""
    out = docs.withColumn("__pii", surrogate(docs.sparkSession, F.col(text), key))
    more = {c: F.col(f"__pii.{c}") for c in ("n_entities", "n_distinct", "n_surrogates", "entities")}
    return out.withColumns({text: F.col("__pii.text")} | more).drop("__pii")


def collisions(entities: DataFrame) -> DataFrame:
    """Surrogates (``kind, surrogate``) that stand for several originals.

    ``entities`` has ``kind, original, surrogate``; the result should be empty.
    """
    flat = F.when(F.col("kind").isin("phone", "card", "id", "iban"), F.regexp_replace("original", r"[^0-9A-Za-z]", "")).when(F.col("kind") == "secret", F.col("original")).otherwise(F.lower("original"))
    same = F.when(F.col("kind").isin("phone", "card", "id", "iban"), F.regexp_replace("surrogate", r"[^0-9A-Za-z]", "")).when(F.col("kind") == "secret", F.col("surrogate")).otherwise(F.lower("surrogate"))
    pairs = entities.select("kind", flat.alias("o"), same.alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
