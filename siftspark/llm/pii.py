"""Personal information in free text, by a skip-chain conditional random field.

Lines become tokens; strings that look like addresses of mail, numbers in groups,
alphanumeric identifiers and street addresses are single tokens, so that a label
decides about an exact stretch. A chain joins neighbouring tokens; skip edges join
repeated and similar tokens of a document, also on distant lines, and carry shared
potentials, so that a name or number gets one label throughout. Inference is loopy belief
propagation: exact forward-backward passes on the chains alternate with messages over
the skip edges, then the best labels are read off. Chains are laid end to end and taken in
batches of like length. Which lines are labelled at all is said at ``Tagger.wanted``.

Weights are fitted here, by gradient ascent on the likelihood under
the same propagation, to sentences that a generator labels while it writes them;
names come from the given list, some altered so that unlisted names are learned too.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators import fuzzy

LABELS = ("O", "email", "phone", "id_number", "address", "B-person", "I-person")
KIND = {1: "email", 2: "phone", 3: "id_number", 4: "address", 5: "person", 6: "person"}
L = len(LABELS)
#: Most names taken from the list (the list is broadcast with the model).
MAX_NAMES = 200_000
#: Sentences the model is fitted to, steps of the fit; lines of the collection itself that show what is no entity.
TRAIN_LINES, STEPS, SEED = 4200, 40, 5
ROUNDS = 3
BACKGROUND_LINES = 2000

_L = r"(?:[^\W\d_]|\\u[0-9a-fA-F]{4})"
_WORD = rf"{_L}+(?:['’\-]{_L}+)*"
_NAME = rf"{_L}(?:{_L}|['’\-])*"
_STREET_EN = r"(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|terrace|drive|dr\.|way|court|ct\.|place|square|sq\.|boulevard|blvd\.?|close|crescent)"
_STREET_DE = r"(?:stra(?:ß|ss|\\u00df)e|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig)"
_STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|all(?:é|\\u00e9|e)e|impasse|quai|cours|route)"
_STREET_ES = r"(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|ronda|carrera)"
_ART = r"(?:(?:de la|de los|de las|de l['’]|des|del|de|du|d['’]|la|le|les)\s?)?"
_NUMBER = r"\d{1,5}(?:\s?[a-zA-Z]\b|\s(?:bis|ter|quater)\b)?"
#: The kinds of tokens, tried in this order at each place.
TOKENS = {
    "email": r"(?P<email>[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z][\w\-]+|[\w.+\-]+\s?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{at\}|(?<=\s)AT(?=\s))\s?[\w\-]+(?:\s?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{dot\}|(?<=\s)DOT(?=\s))\s?[\w\-]+|\.[\w\-]+)+)",
    "address": rf"(?P<address>(?i:{_NUMBER},?\s(?:[nsew]\.?\s)?{_NAME}(?:\s{_NAME})?\s{_STREET_EN}(?!\w)|{_NUMBER},?\s{_STREET_FR}\s{_ART}{_NAME}|{_L}{{2,}}{_STREET_DE}\s{_NUMBER}|{_STREET_ES}\s{_ART}{_NAME},?\s(?:n[º°o]\.?\s)?{_NUMBER}))(?!\w)",
    "code": r"(?P<code>\b[A-Z]{2}\s?\d{2}(?:\s?\d{4}){2,7}(?:\s?\d{1,4})?\b|\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b|\b\d{7,8}\s?-?\s?[A-Z]\b|\b(?=[A-Z0-9]*\d[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{7,12}\b)",
    "digits": r"(?P<digits>(?<![\w.])(?:\(\+\d{1,3}\)\s?|\+\s?)?\(?\d{1,5}\)?(?:[ ./\-]?\(?\d{1,5}\)?){2,8}(?!\w)|(?<![\w.])\+?\d{7,15}(?!\w))",
    "escape": r"(?P<escape>\\[nrtbf\"/\\])",
    "initial": rf"(?P<initial>\b[A-ZÀ-Ž]\.(?=\s))",
    "word": rf"(?P<word>{_WORD})",
    "number": r"(?P<number>\d+)",
    "sign": r"(?P<sign>[^\w\s]|_)",
}


@functools.cache
def _tokens(mail: bool, street: bool, digit: bool) -> re.Pattern:
    """The pattern of all tokens without those that a line cannot hold, which are the slow ones."""
    left = ({"email"} if not mail else set()) | ({"address"} if not street else set()) | ({"code", "digits", "number"} if not digit else set())
    return re.compile("|".join(p for k, p in TOKENS.items() if k not in left))


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_DIGITS = re.compile(r"\d(?:[ ./()\-]*\d){6}")
_PLAIN_NUMBER = re.compile(r"\+?\d+")
_ANY_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"[A-Z]{2}\s?\d\d\s?\d\d|[A-Z0-9]{8}")
#: Words of the street patterns above; German ones are endings before a number.
_STREET_WORDS = frozenset("street st avenue ave road rd lane ln terrace drive dr way court ct place square sq boulevard blvd close crescent rue av bd chemin allée allee impasse quai cours route calle avda avenida plaza pza paseo camino ronda carrera".split())
_STREET_END = re.compile(r"(?<=[a-zß.])\s\d", re.I)
_GERMAN_ENDS = ("straße", "strasse", "stra\\u00dfe", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig")
_SPELT = re.compile(r"[\[({](?:at|AT)[\])}]|\sAT\s")
_CAPITALS = re.compile(r"[A-ZÀ-Ž](?:\w|['’\-])*,?\s(?:[A-ZÀ-Ž]\.\s)?(?:\w+\s){0,3}[A-ZÀ-Ž\\](?:\w|['’])")
_LETTERS = re.compile(r"[^\W\d_]{2,}")


def _words_of(line: str) -> list[str]:
    """Runs of letters in lower case; escapes are not part of them."""
    if "\\" in line:
        line = re.sub(r"\\[nrtbf]", " ", _plain(line))
    return _LETTERS.findall(line.lower())


def _may_be_street(line: str, words: list[str]) -> bool:
    """For lines with a digit: no address pattern matches without this."""
    if not _STREET_WORDS.isdisjoint(words):
        return True
    low = line.lower()
    return "c/" in low or any(low.endswith(_GERMAN_ENDS, 0, m.start()) for m in _STREET_END.finditer(line))


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text) if "\\u" in text else text


def _shape(w: str) -> str:
    return "lower" if w.islower() else "upper" if w.isupper() and len(w) > 1 else "title" if w[:1].isupper() and w[1:].islower() else "hyphen" if w[:1].isupper() and "-" in w else "mixed"


def tokenise(line: str) -> list[tuple[str, int, int, str]]:
    """(type, start, end, text) of the tokens; digit groups lose trailing signs."""
    out = []
    at = 0
    digit = bool(_ANY_DIGIT.search(line))
    find = _tokens("@" in line or bool(_SPELT.search(line)), digit and _may_be_street(line, _words_of(line)), digit).search
    while m := find(line, at):
        kind, a, b = m.lastgroup, m.start(), m.end()
        text = m[0]
        if kind == "digits":
            n = sum(c.isdigit() for c in text)
            if n < 7:  # short numbers stand alone
                first = _PLAIN_NUMBER.search(line, a, b)
                if line[a] in "(+" and not line[a].isdigit() and first.start() > a:
                    kind, b = "sign", a + 1
                else:
                    kind, b = "number", first.end()
                text = line[a:b]
            else:
                while text and not (text[-1].isdigit() or text[-1] == ")" and text.count("(") == text.count(")")):
                    text = text[:-1]
                if text.count("(") != text.count(")"):
                    if text[0] == "(":
                        kind, text = "sign", "("
                    else:
                        text = text[: text.index("(")].rstrip() if "(" in text else text[: text.index(")")]
                        kind = "digits" if sum(c.isdigit() for c in text) >= 7 else "number"
                b = a + len(text)
        elif kind == "email":
            while text[-1] in ".-+":
                text = text[:-1]
            while text[0] in ".-+":
                text, a = text[1:], a + 1
            b = a + len(text)
        out.append(("sign" if kind == "escape" else kind, a, b, text))
        at = max(b, at + 1)
    return out


class Features:
    """Feature ids of tokens; frozen after fitting."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.given, self.family, self.frozen = given, family, False

    def of(self, kind: str, text: str, follows: str = "", listed: bool = True) -> tuple[list[int], int]:
        """(ids, list membership: 1 given, 2 family)."""
        names, flags = [f"t={kind}"], 0
        if kind == "word":
            w = _plain(text)
            low = w.lower()
            if listed:
                flags = (low in self.given) + 2 * (low in self.family)
            names += [f"w={low}", f"s={_shape(w)}", f"x3={low[-3:]}", f"x4={low[-4:]}", f"f={flags}", f"fs={flags}{_shape(w)}"]
        elif kind in ("digits", "code"):
            mask = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text))
            names += [f"m={mask}", f"n={sum(c.isdigit() for c in text)}", f"h={mask[:3]}", f"g={re.sub('9+', '9', mask)}", f"d={text[:2]}"]
        elif kind == "email":
            local = re.split(r"@|\s?[(\[{]?(?:at|AT)[)\]}]?\s", text)[0].lower()
            names += [f"l={local}" if local in ("git", "deploy", "root", "admin", "ssh", "svn", "hg") else "l=", f"c={follows in ':/'}" if follows else "c="]
        elif kind == "address":  # several features of its own, as the neighbours have several
            low = text.lower()
            names += ["a=any", f"a={re.sub(r'[0-9]+', '9', re.sub(r'[^0-9 .,]+', 'w', low))}", f"e={low[-3:]}", f"b={low.split()[0][:4]}"]
        elif kind == "number":
            names += [f"k={len(text)}"]
        elif kind == "sign":
            names += [f"p={text}"]
        if self.frozen:
            return [i for n in names if (i := self.ids.get(n))], flags
        return [self.ids.setdefault(n, len(self.ids)) for n in names], flags


ROLES = (0, -1, -2, 1, 2, -3, -4)
_BAG = {-3: 5, -4: 5}  # the third and fourth token before share weights


def _role(offset: int) -> int:
    return {0: 0, -1: 1, -2: 2, 1: 3, 2: 4, -3: 5, -4: 5}[offset]


class Model:
    """Weights: per role and feature, per list-membership context, transitions, skip edges."""

    def __init__(self, features: Features) -> None:
        self.features = features
        self.w = np.zeros((6, len(features.ids), L))
        self.context = np.zeros((64, L))
        self.trans = np.zeros((L, L))
        self.start = np.zeros(L)
        self.skip = np.array([0.5, 0.5, 0.0])  # same kind, both O, otherwise

    def compile(self) -> None:
        """Freeze the features and empty the table of sums per token."""
        self.features.frozen = True
        self.cache: dict = {}
        self.table, self.flags = np.zeros((1024, 6, L), np.float32), np.zeros(1024, np.int64)

    def row(self, kind: str, text: str, follows: str) -> int:
        """Place of a token's sums in the table; 0 is no token."""
        key = (kind, text, follows if kind == "email" else "")
        at = self.cache.get(key)
        if at is None:
            ids, flags = self.features.of(kind, text, follows)
            at = self.cache[key] = len(self.cache) + 1
            if at == len(self.table):
                self.table, self.flags = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.flags, np.zeros_like(self.flags)])
            self.table[at] = self.w[:, ids].sum(1) if ids else 0
            self.flags[at] = flags
        return at

    def skip_matrix(self) -> np.ndarray:
        m = np.full((L, L), self.skip[2])
        for a in range(L):
            for b in range(L):
                if KIND.get(a) == KIND.get(b):
                    m[a, b] = self.skip[0] if a else self.skip[1]
        return m


#: A person goes on only from a person; nothing else has parts.
ALLOWED = np.zeros((L, L))
ALLOWED[:, 6] = -1e4
ALLOWED[5, 6] = ALLOWED[6, 6] = 0.0


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


class Layout:
    """Chains laid end to end, and batches of chains of like length: (chains, lengths, places (B, T))."""

    def __init__(self, length: np.ndarray, chosen: np.ndarray | None = None) -> None:
        self.length = length
        self.start = np.cumsum(length) - length
        chosen = np.arange(len(length)) if chosen is None else chosen
        order = chosen[np.argsort(length[chosen], kind="stable")]
        self.batches = []
        at = 0
        while at < len(order):
            least = length[order[at]]
            end = int(np.searchsorted(length[order], 1.3 * least + 3, side="right"))
            end = min(max(end, at + 1), at + max(1, int(200_000 // max(1, length[order[min(end, len(order)) - 1]]))))
            chains = order[at:end]
            n = length[chains]
            places = self.start[chains][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
            self.batches.append((chains, n, places))
            at = end


def _chains(node: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Scaled forward and backward sums of a batch of chains, and the scaled node factors (B, T, L)."""
    T = node.shape[1]
    factor = np.exp(node - node.max(-1, keepdims=True))
    step = np.exp(trans).astype(node.dtype)
    back = np.ascontiguousarray(step.T)
    alpha, beta = np.empty_like(node), np.ones_like(node)
    first = np.exp(start).astype(node.dtype)
    first[6] = 0.0
    alpha[:, 0] = _norm(factor[:, 0] * first)
    for t in range(1, T):
        alpha[:, t] = _norm((alpha[:, t - 1] @ step) * factor[:, t])
    for t in range(T - 2, -1, -1):
        beta[:, t] = _norm((factor[:, t + 1] * beta[:, t + 1]) @ back)
        ended = t + 1 >= length
        if ended.any():
            beta[ended, t] = 1.0
    return alpha, beta, factor


def _sums(node: np.ndarray, layout: Layout, model: Model):
    """Forward, backward and factor of flat nodes (N, L); places of chains that are not in the layout stay 0."""
    alpha, beta, factor = np.zeros_like(node), np.zeros_like(node), np.zeros_like(node)
    trans = model.trans + ALLOWED
    for _, n, places in layout.batches:
        own = np.arange(places.shape[1]) < n[:, None]
        for out, got in zip((alpha, beta, factor), _chains(node[places], n, trans, model.start)):
            out[places[own]] = got[own]
    return alpha, beta, factor


def propagate(emit: np.ndarray, layout: Layout, edges: np.ndarray, model: Model, rounds: int = ROUNDS, last: bool = True):
    """(node potentials with skip messages, alpha, beta, factors, messages to a, to b).

    ``emit`` (N, L); ``edges`` (E, 2) of places. Messages are probabilities; each leaves
    out what came over the same edge. Without ``last`` the sums of the last round are
    left out, where only the nodes are wanted.
    """
    psi = np.exp(model.skip_matrix()).astype(emit.dtype)
    to_b = np.full((len(edges), L), 1.0 / L, emit.dtype)
    to_a = to_b.copy()
    node, sums = emit, (None, None, None)
    for r in range(rounds if len(edges) else 1):
        if r:
            node = emit.copy()
            np.add.at(node, edges[:, 1], np.log(np.maximum(to_b, 1e-30)))
            np.add.at(node, edges[:, 0], np.log(np.maximum(to_a, 1e-30)))
        end = r == rounds - 1 or not len(edges)
        if end and not last:
            break
        alpha, beta, factor = sums = _sums(node, layout, model)
        if end:
            break
        a, b = (_norm(alpha[e] * beta[e]) for e in edges.T)
        new_b = _norm((a / np.maximum(to_a, 1e-30)) @ psi)
        to_a = _norm((b / np.maximum(to_b, 1e-30)) @ psi.T)
        to_b = new_b
    return node, *sums, to_a, to_b


def viterbi(node: np.ndarray, layout: Layout, model: Model) -> np.ndarray:
    """Best label of each place."""
    out = np.zeros(len(node), np.int8)
    trans = (model.trans + ALLOWED).astype(node.dtype)
    for _, n, places in layout.batches:
        B, T = places.shape
        x = node[places]
        best = x[:, 0] + model.start.astype(node.dtype)
        best[:, 6] = -1e4
        back = np.zeros((B, T, L), np.int8)
        last = best.argmax(1)
        for t in range(1, T):
            s = best[:, :, None] + trans
            back[:, t] = s.argmax(1)
            best = s.max(1) + x[:, t]
            ends = n == t + 1
            if ends.any():
                last[ends] = best[ends].argmax(1)
        y = np.zeros((B, T), np.int8)
        now = last.astype(np.int8)
        rows = np.arange(B)
        for t in range(T - 1, -1, -1):
            inside = t < n
            y[:, t] = now
            if t:
                now = np.where(inside, back[rows, t, now], now)
        own = np.arange(T) < n[:, None]
        out[places[own]] = y[own]
    return out


# ---------------------------------------------------------------- training text


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randrange(10)) if c == "9" else r.choice("ABCDEFGHJKLMNPRSTW") if c == "A" else c for c in pattern)


#: Common written forms of phone numbers and identity numbers.
PHONES = ("+1 999 555 0199", "+19995550199", "(999) 555-0199", "999.555.0199", "999-555-0199", "+44 1632 960999", "01632 960 999", "07700 900999", "+44 7700 900999", "+49 30 23125 999", "030/23125-999", "0049 (0)30 23125999", "+33 1 99 00 99 99", "01.99.00.99.99", "01 99 00 99 99", "+34 555 000 999", "+34 999 999 999", "0999 999999", "+49 (0)99 9999999", "(+44) 1632 960999")
IDS = {
    "SSN|ssn:|social security no.|Social Security number": ("999-99-9999", "999 99 9999", "999999999"),
    "NI number|national insurance|NINO": ("AA999999A", "AA 99 99 99 A", "QQ999999B", "QQ 99 99 99 C"),
    "tax id|TIN|Steuer-ID|Steuernummer|tax number|numéro fiscal": ("99 999 999 999", "99999999999", "00 999 999 999"),
    "IBAN|account|account no.|Konto|cuenta|compte": ("XX99 0000 9999 9999 99", "AA99 9999 9999 9999 99", "AA99999999999999999999"),
    "passport|Reisepass|passeport|pasaporte|Passport no.": ("X0Q999999", "A99A99999", "A9999999", "C9AA99999"),
    "DNI|NIF|documento": ("99999999-A", "99999999A"),
    "NIR|n° de sécurité sociale|numéro de sécurité sociale": ("9 99 99 99 999 999", "0 00 99 00 999 999", "9 99 99 99 999 999 99"),
}
#: Number forms that are not personal, with the words around them.
DECOYS = (
    "checksum {00 499 999 999} belongs to {w}.{w}", "order code {599-99-9999} stays reserved for {w} parts", "Build {2031-05-5559999} passed on port 5432.", "Host 192.0.2.{99} answered after {9} ms.",
    "Pinned {w}-{w}@{9}.2.1 for now.", "ssh deploy@192.0.2.{99} then {w} the {w}", "git clone git@forge.example:{w}/{w}_{w}.git", "Decorate it with @{w}_{w} or @{w}.{w}.", "ticket {99999999} was closed", "commit {9999999} touches {w}",
    "request id {999-99-9999} expired", "serial {AA999999A} of the {w}", "part no. {99 999 999 999} is out of stock", "version {9}.{99}.{999} of {w}", "at {w}_{w} ({w}/{w}.py:{99})", "hash {A99A99999} of the {w}", "invoice number {99999999999}", "batch {AA99 9999 9999 9999 99} of {w}", "rsync backup@storage.example:/{w} {w}", "timestamp {9999999999} in {w}",
)
STREETS = ("{n} {S} Street", "{n} {S} Road", "{n} {S} Lane", "{n} {S} Terrace", "{n} {c}. {S} Ave", "{n} {S} Ave", "{n} {s} st.", "{n} {S} St.", "{S}straße {n}", "{S}weg {n} b", "{S}gasse {n}a", "{S}allee {n} b", "{S}weg {n}", "Calle {S} {n}", "Avda. de {S}, {n}", "Plaza {S} {n}", "{n}, rue des {S}s", "{n} bis, avenue de {S}", "{n}, rue de {S}", "{n} avenue de {S}")
TEMPLATES = (
    "Contact: [email] or [phone] (ask for [person])", "Questions go to [person], phone [phone].", "Reported by [person] ([email]).", "[person] <[email]> asked for a second look.", "According to [person], the badge lists [id].",
    "The customer gave [id] and wants it removed.", "caller [phone] said the form shows [id] in clear text", "Record of [person]: [id], [address], {S}", "Ship the spare {w} to [person], [address], {p} {S}.", "He lives at [address], {S}, {p}, and reads mail at [email].",
    "Approved by Dr. [person] after the review.", "met [person] in the hallway, will follow up", "escalate to [person] if nobody answers [phone]", "Signed-off-by: [person] <[email]>", "author: [person] <[email]>", "TODO([person]): ask before the next release, [phone]",
    "see mail from [person], [email]", "Mail to [email] bounced twice.", "cc [email], [email]", "maintainer = \"[email]\"", "customer row: \"[person]\",\"[address]\",\"[email]\",\"[phone]\"", "test data: name=[person]; street=[address]; [idkv]", "{\"user\": \"[person]\", \"phone\": \"[phone]\"}",
    "- owner: [person]", "- desk: [phone]", "- mail: [email]", "On call this week: [person] - [phone]", "Gemeldet von [person] ([email]).", "Rückfragen bitte an [person], Tel. [phone].", "Lieferung an [person], [address], {p} {S}.", "Im Formular stand [id].",
    "Signalé par [person] ([email]).", "Pour toute question, appelez [person] au [phone].", "Le formulaire affichait [id].", "Livrer la pièce à [person], [address], {p} {S}.", "Envoyer le module à [person], [address], {S}.", "Send the part to [person], [address], {S}, {p}.", "{\"name\": \"[person]\", \"phone\": \"[phone]\"}", "{\"user\": \"[person]\", \"mail\": \"[email]\"}", "[person] [email]", "Avisado por [person] ([email]).", "Para dudas llame a [person], tel. [phone].", "En el formulario aparece [id].",
    "Enviar la pieza a [person], [address], {S}.", "[person]", "[address]", "Tel. [phone]", "{p} {S}", "{S}", "{S}, {p}", "Thanks,", "reviewed with [person] and [person]", "{w} [person] {w}", "Regards, [person]", "Dear Mr. [person],", "(ask for [person])", "phone: [phone], fax [phone]",
)
WORDS = "the a when of each waits files pages rows must before after once more than only buffer cache queue value record index parse merge split restore page module class function return import error warning server client token session render update delete insert select where table column key node graph list tree branch release test build deploy config default option field schema batch stream worker thread lock timeout retry limit window counter chunk report review issue patch change version package project service method object string integer number array option state layer loader filter handler manager context pattern vector policy der die das und wird nicht eine für mit auf von bei nach datei tabelle größe länge suche le la les une des est pour avec dans période règle mémoire el los una por para con según página versión conexión May Grace Mark open silent nested primary".split()


def _invent(r: random.Random, names: list[str]) -> str:
    a, b = r.choice(names), r.choice(names)
    return a[: max(2, len(a) // 2)] + b[len(b) // 2 :].lower()


def _person(r: random.Random, given: list[str], family: list[str]) -> str:
    g = r.choice(given).title() if r.random() < 0.8 else _invent(r, given).title()
    f = r.choice(family) if r.random() < 0.8 else _invent(r, family)
    f = f if any(c.isupper() for c in f[:1]) else f.title() if " " not in f else f
    if r.random() < 0.08 and " " not in f:
        f = r.choice(("van der ", "de ", "von ", "da ", "de la ", "del ", "van ", "di ", "O'", "Mc")) + f
    if r.random() < 0.04:
        f = f + "-" + r.choice(family)[:3].title()
    x = r.random()
    if r.random() < 0.12:
        g += f" {r.choice('ABCDEGHJKLMNPRST')}."
    whole = f"{f}, {g}" if x < 0.2 else f"{g} {f.upper()}" if x < 0.28 else f"{g} {f}".lower() if x < 0.38 else f"{g} {f}"
    return whole


def _mail(r: random.Random, person: str) -> str:
    parts = [re.sub(r"[^a-z]", "", p) or "x" for p in person.lower().replace(",", " ").split()][:2]
    local = r.choice((".".join(parts), "_".join(parts), "-".join(parts), parts[-1] + str(r.randrange(99)), parts[0][0] + parts[-1], parts[0] + "+news", "billing", "oncall", "support", "noreply", "security"))
    host = r.choice(("example.com", "example.org", "mail.north.test", "eu.west.example", "plant.invalid", "example.net", "lab.example"))
    x = r.random()
    if x < 0.75:
        return f"{local}@{host}"
    if x < 0.83:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    if x < 0.91:
        return f"{local} (at) {host}"
    return f"{local} AT {host.replace('.', ' DOT ')}"


def training_lines(given: list[str], family: list[str], n: int = TRAIN_LINES, seed: int = SEED) -> list[list[tuple[str, list[tuple[int, int, str]]]]]:
    """Labelled documents of one to four lines: (text, [(start, end, kind)])."""
    r = random.Random(seed)
    docs, made = [], 0
    places = ["Northby", "Eastholm", "Santa Lira", "Bad Ehrn", "Villeroc", "Port-Lenn"]

    def slot(kind: str, person: str) -> tuple[str, str | None, int]:
        """(text, kind, length of an unlabelled lead)."""
        if kind == "person":
            return person, "person", 0
        if kind == "email":
            m = _mail(r, person)
            return (m.upper() if r.random() < 0.07 else m), "email", 0
        if kind == "phone":
            return _digits(r, r.choice(PHONES)), "phone", 0
        if kind == "address":
            s = _invent(r, family).title()
            t = r.choice(STREETS).format(n=r.randrange(1, 500), S=s.replace(" ", ""), s=s.lower(), c=r.choice("NSEW"))
            return t, "address", 0
        label, forms = r.choice(list(IDS.items()))
        lead = r.choice(label.split("|")) + ("=" if kind == "idkv" else r.choice((" ", " ", ": ", "=")))
        return lead + _digits(r, r.choice(forms)), "id_number", len(lead)

    def fill(m: re.Match) -> str:
        return _digits(r, m[1]) if m[1][:1].isdigit() or m[1][:1] == "A" else r.choice(WORDS)

    def noise(k: int) -> str:
        w = [r.choice(WORDS) for _ in range(k)]
        if r.random() < 0.4:
            w[0] = w[0].title()
        if r.random() < 0.3:
            w[r.randrange(k)] = str(r.randrange(4000))
        return " ".join(w) + r.choice((".", "", ",", ";", ":"))

    while made < n:
        lines = []
        person = _person(r, given, family)
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            spans: list[tuple[int, int, str]] = []
            x = r.random()
            if x < 0.2:
                text = re.sub(r"\{([^}]+)\}", fill, r.choice(DECOYS))
            elif x < 0.34:
                text = noise(r.randrange(3, 14))
                if r.random() < 0.5:  # headings and lone names or capitals are no persons
                    text = r.choice(("## ", "# ", "", "- ", "Subject: Re: ")) + " ".join(r.choice(WORDS).title() for _ in range(r.randrange(2, 4)))
                elif r.random() < 0.3:
                    text = noise(4) + " " + r.choice(given).title() + " " + noise(4)
            else:
                template = r.choice(TEMPLATES).replace("{p}", f"{r.randrange(1000):05d}").replace("{S}", r.choice(places) if r.random() < 0.5 else _invent(r, family).title())
                template = re.sub(r"\{w\}", lambda m: r.choice(WORDS), template)
                if r.random() < 0.3:
                    template = r.choice(("# ", "// ", "- ", "    ", "> ", "* ", "1. ", "-- ", "{\"role\": \"user\", \"text\": \"")) + template
                elif r.random() < 0.25:
                    template = noise(r.randrange(3, 8)) + " " + template
                if r.random() < 0.2:
                    template = template + " " + noise(r.randrange(3, 8))
                text, at = "", 0
                for m in re.finditer(r"\[(person|email|phone|id|idkv|address)\]", template):
                    text += template[at : m.start()]
                    if m[1] == "person" and r.random() < 0.3:
                        person = _person(r, given, family)
                    value, kind, lead = slot(m[1], person)
                    spans.append((len(text) + lead, len(text) + len(value), kind))
                    text += value
                    at = m.end()
                text += template[at:]
            lines.append((text, spans))
            made += 1
        docs.append(lines)
    return docs


def _similar(a: str, b: str) -> bool:
    """Words that differ by an ending, a hyphened part or a letter or two."""
    if a.startswith(b) or b.startswith(a):
        return True
    return fuzzy.ratio(a, b) >= 80


def skip_edges(docs: list[list[list[tuple]]], start: np.ndarray, listed: set[str]) -> np.ndarray:
    """(E, 2) places of the skip edges, of successive equal and successive similar tokens of a document.

    ``docs``: per document its lines of tokens; ``start``: place of each line. Equal are
    words without regard to case, and numbers without regard to separators; similar are
    words of five letters and more that begin alike (``_similar``), and numbers of the same
    last seven digits. Words that are nowhere in the document written like a name or listed as one
    have no edges.
    """
    edges: list[tuple[int, int]] = []
    line = 0
    for lines in docs:
        groups: dict[str, list] = {}
        for tokens in lines:
            base = int(start[line])
            line += 1
            for t, (kind, _, _, text) in enumerate(tokens):
                if kind == "word":
                    if len(text) < 3:
                        continue
                    word = _plain(text)
                    key = word.lower()
                    group = groups.get(key)
                    if group is None:
                        group = groups[key] = [key in listed, kind, []]
                    group[0] = group[0] or word[0].isupper()
                elif kind in ("digits", "code"):
                    group = groups.setdefault("#" + re.sub(r"\W", "", text), [True, kind, []])
                elif kind in ("email", "address"):
                    group = groups.setdefault("@" + text.lower(), [True, kind, []])
                else:
                    continue
                group[2].append(base + t)
        heads: dict[str, tuple[str, int]] = {}
        for key, (named, kind, places) in groups.items():
            if not named:
                continue
            edges += zip(places, places[1:])
            near = key[:5] if kind == "word" and len(key) >= 5 else key[-7:] if key[0] == "#" and len(key) > 8 else None
            if near is not None:
                if near in heads and (kind != "word" or _similar(heads[near][0], key)):
                    edges.append((heads[near][1], places[0]))
                heads[near] = (key, places[-1])
    return np.array(edges, np.int64).reshape(-1, 2)


def fit(given: list[str], family: list[str], background: list[str] = ()) -> Model:
    """Model for a list of names; deterministic. ``background``: lines without entities."""
    r = random.Random(SEED + 1)
    given, family = sorted(given) or ["Ann"], sorted(family) or ["Smith"]
    parts = lambda names: {w for n in names for w in n.lower().split() if len(w) > 2}
    feats = Features(parts(given), parts(family))
    lines, tags, docs, ids, flags = [], [], [], [], []
    for doc in [*training_lines(given, family), *([(b, [])] for b in background)]:
        made = []
        for text, spans in doc:
            tokens = tokenise(text)[:40]
            if not tokens:
                continue
            y = []
            for kind, a, b, _ in tokens:
                lab = 0
                for s, e, k in spans:
                    if a < e and b > s:
                        if k == "person":
                            lab = 5 if a <= s else 6
                        elif a == s and b == e:
                            lab = {"email": 1, "phone": 2, "id_number": 3, "address": 4}[k]
                y.append(lab)
            made.append(tokens)
            lines.append(tokens)
            tags.append(y)
            row, fl = [], []
            for kind, a, b, t in tokens:
                i, f = feats.of(kind, t, text[b : b + 1], listed=r.random() > 0.25)
                row.append(i)
                fl.append(f)
            ids.append(row)
            flags.append(fl)
        docs.append(made)
    model = Model(feats)
    K = 8
    layout = Layout(np.array([len(x) for x in lines]))
    N = int(layout.length.sum())
    X = np.zeros((N, K), np.int32)
    for t, i in enumerate(i for row in ids for i in row):
        X[t, : len(i)] = i[:K]
    Y = np.fromiter((y for row in tags for y in row), np.int64, N)
    FL = np.fromiter((f for row in flags for f in row), np.int64, N)
    first = np.zeros(N, bool)
    first[layout.start] = True
    pos = np.arange(N) - np.repeat(layout.start, layout.length)
    left = np.repeat(layout.length, layout.length) - 1 - pos

    def shift(a: np.ndarray, o: int) -> np.ndarray:
        """Of each place the row ``o`` places on in its chain, 0 beyond."""
        inside = (pos + o >= 0) & (o <= left)
        out = np.zeros_like(a)
        out[inside] = a[np.flatnonzero(inside) + o]
        return out

    flat_ctx = shift(FL, -1) * 16 + FL * 4 + shift(FL, 1)
    edges = skip_edges(docs, layout.start, feats.given | feats.family)
    shifted = {o: shift(X, o) for o in ROLES}
    # per role the places and features that are there, for sums over places
    used = {o: (np.repeat(np.arange(N), (x > 0).sum(1)), x[x > 0]) for o, x in shifted.items()}
    want = np.eye(L)[Y]
    F_ = len(feats.ids)
    params = [model.w, model.context, model.trans, model.start, model.skip]
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    second = np.flatnonzero(~first)
    kinds = np.array([[(0 if a else 1) if KIND.get(a) == KIND.get(b) else 2 for b in range(L)] for a in range(L)])
    for step in range(1, STEPS + 1):
        emit = model.context[flat_ctx]
        for o, idx in shifted.items():
            emit += model.w[_role(o)][idx].sum(1)
        node, alpha, beta, factor, to_a, to_b = propagate(emit, layout, edges, model)
        prob = _norm(alpha * beta)
        diff = want - prob
        grads = [np.zeros_like(p) for p in params]
        for o, (at, idx) in used.items():
            for lab in range(L):
                grads[0][_role(o), :, lab] += np.bincount(idx, weights=diff[at, lab], minlength=F_)
        for lab in range(L):
            grads[1][:, lab] = np.bincount(flat_ctx, weights=diff[:, lab], minlength=64)
        step_ = np.exp(model.trans + ALLOWED)
        right = factor[second] * beta[second]
        before = alpha[second - 1]
        share = 1.0 / np.maximum(((before @ step_) * right).sum(1), 1e-300)
        pairs = step_ * ((before * share[:, None]).T @ right)
        seen = np.zeros((L, L))
        np.add.at(seen, (Y[second - 1], Y[second]), 1)
        grads[2] = seen - pairs
        grads[3] = want[layout.start].sum(0) - prob[layout.start].sum(0)
        if len(edges):
            j = (prob[edges[:, 0]] / to_a)[:, :, None] * (prob[edges[:, 1]] / to_b)[:, None, :] * np.exp(model.skip_matrix())
            j /= np.maximum(j.sum((1, 2), keepdims=True), 1e-300)
            told = kinds[Y[edges[:, 0]], Y[edges[:, 1]]]
            for c in range(3):
                grads[4][c] = (told == c).sum() - j[:, kinds == c].sum()
        for p, g, a, b in zip(params, grads, m1, m2):
            g -= 0.15 * p  # Gaussian prior
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    model.compile()
    return model


# ---------------------------------------------------------------- application


class Tagger:
    """Labels the lines of documents in groups, long lines in overlapping stretches.

    Of the tokens two stretches share, the first half is the former's and the second half
    the latter's: a span is taken from the stretch that owns its first token, which sees
    it whole.
    """

    WIDTH, OVERLAP, GROUP, CACHE = 240, 40, 4000, 200_000

    def __init__(self, model: Model) -> None:
        self.m = model
        self.listed = model.features.given | model.features.family

    def wanted(self, line: str) -> bool:
        """Lines that can hold an entity: a mail sign, a long number or code, a number with a street word, two
        capitalised words up to three words apart, or a listed name.

        Lines that repeat a word of a name found elsewhere in the document are labelled too (``tag``).
        A line without any of this is left alone.
        """
        if "@" in line or _CAPITALS.search(line) or _SPELT.search(line):
            return True
        words = _words_of(line)
        if not self.listed.isdisjoint(words):
            return True
        return bool(_ANY_DIGIT.search(line)) and bool(_DIGITS.search(line) or _CODE.search(line) or _may_be_street(line, words))

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text the (start, end, kind) found in it, sorted, none inside another."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        held, chains = [], 0
        for d, text in enumerate(texts):
            lines, at = [], 0
            for line in text.split("\n"):
                if line and self.wanted(line):
                    lines.append((line, at))
                at += len(line) + 1
            if lines:
                held.append((d, lines))
                chains += len(lines)
            if chains >= self.GROUP:
                self._group(texts, held, found)
                held, chains = [], 0
        if held:
            self._group(texts, held, found)
        return [apart(f) for f in found]

    def _group(self, texts, held, found) -> None:
        self._run(held, found)
        again = []
        for d, lines in held:  # other lines with words of the names found
            names = {w for a, b, k in found[d] if k == "person" for w in _words_of(texts[d][a:b]) if len(w) > 3}
            if not names:
                continue
            have, more, at = {at for _, at in lines}, [], 0
            for line in texts[d].split("\n"):
                if line and at not in have and not names.isdisjoint(_words_of(line)):
                    more.append((line, at))
                at += len(line) + 1
            if more:
                found[d] = []
                again.append((d, sorted([*lines, *more], key=lambda x: x[1])))
        if again:
            self._run(again, found)

    def _run(self, held, found) -> None:
        m = self.m
        if len(m.cache) > self.CACHE:
            m.compile()
        docs, owners = [], []
        for d, lines in held:
            parts = []
            for line, at in lines:
                tokens = tokenise(line)
                for lo in range(0, max(1, len(tokens) - self.OVERLAP), self.WIDTH - self.OVERLAP):
                    part = tokens[lo : lo + self.WIDTH]
                    if part:
                        parts.append(part)
                        own = (0 if lo == 0 else self.OVERLAP // 2, len(part) if lo + self.WIDTH >= len(tokens) else self.WIDTH - self.OVERLAP // 2)
                        owners.append((d, line, at, own))
            if parts:
                docs.append(parts)
        chains = [part for doc in docs for part in doc]
        if not chains:
            return
        length = np.array([len(c) for c in chains])
        start = np.cumsum(length) - length
        # rows with four empty ones before and after each chain, so that neighbours are found by shifting
        rows = np.zeros(int(length.sum()) + 4 * (len(chains) + 1), np.int64)
        place = np.arange(length.sum()) + 4 * (np.repeat(np.arange(len(chains)), length) + 1)
        rows[place] = [m.row(k, t, line[e : e + 1]) for tokens, (_, line, _, _) in zip(chains, owners) for k, _, e, t in tokens]
        flag = m.flags[rows]
        emit = m.context.astype(np.float32)[flag[place - 1] * 16 + flag[place] * 4 + flag[place + 1]]
        for o in ROLES:
            emit += m.table[rows[place + o], _role(o)]
        edges = skip_edges(docs, start, self.listed)
        node = emit
        if len(edges):  # only documents with edges need rounds
            doc = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
            at = np.searchsorted(start, edges[:, 0], side="right") - 1
            chosen = np.flatnonzero(np.isin(doc, np.unique(doc[at])))
            node = propagate(emit, Layout(length, chosen), edges, m, last=False)[0]
        best = viterbi(node, Layout(length), m)
        for c in np.unique(np.searchsorted(start, np.flatnonzero(best), side="right") - 1).tolist():
            tokens, (d, _, at, own) = chains[c], owners[c]
            y = best[start[c] : start[c] + len(tokens)].tolist()
            t = 0
            while t < len(tokens):
                lab = y[t]
                if not lab:
                    t += 1
                    continue
                e = t + 1
                while lab == 5 and e < len(tokens) and y[e] == 6:
                    e += 1
                if own[0] <= t < own[1] and _sound(KIND[lab], tokens[t:e]):
                    found[d].append((at + tokens[t][1], at + tokens[e - 1][2], KIND[lab]))
                t = e


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order; of overlapping ones the longest stays, then the first."""
    kept: list[tuple[int, int, str]] = []
    for s in sorted(set(spans), key=lambda x: (x[0] - x[1], x)):
        at = bisect_left(kept, s)
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or s[1] <= kept[at][0]):
            kept.insert(at, s)
    return kept


def _sound(kind: str, tokens: list[tuple]) -> bool:
    """Whole stretches only: a person has two names, other kinds their token type."""
    if kind == "person":
        if any(k not in ("word", "initial") and t != "," for k, _, _, t in tokens) or sum(k == "word" for k, _, _, _ in tokens) > 5:
            return False
        return sum(k == "word" and len(t) > 1 for k, _, _, t in tokens) >= 2 and tokens[-1][0] in ("word", "initial")
    types = {"email": ("email",), "phone": ("digits",), "id_number": ("digits", "code"), "address": ("address",)}
    return tokens[0][0] in types[kind]


def shows_nothing(line: str, listed: set[str]) -> bool:
    """A line with words but no listed name, mail sign, long number or street: hardly an entity."""
    if not 20 <= len(line) <= 200 or "@" in line or re.search(r"\d(?:\W?\d){6}|\b[aA][tT]\b", line):
        return False
    words = re.findall(r"[^\W\d_]{2,}", _plain(line))
    if len(words) < 4 or any(w.lower() in listed for w in words):
        return False
    return not any(k in ("address", "code", "email", "digits") for k, *_ in tokenise(line))


def background_lines(df: DataFrame, text_col: str, listed: set[str]) -> list[str]:
    """BACKGROUND_LINES lines that show no entity, those of least hash in the whole table."""

    def pick(it):
        best: dict[str, int] = {}
        most = 1 << 63  # hashes from here on are not among the least
        for batch in it:
            for text in batch.column("text").to_pylist():
                for line in text.split("\n"):
                    if 20 <= len(line) <= 200 and (h := xxhash.xxh3_64_intdigest(line) >> 1) < most and line not in best and shows_nothing(line, listed):
                        best[line] = h
                        if len(best) >= 2 * BACKGROUND_LINES:
                            best = dict(sorted(best.items(), key=lambda x: x[1])[:BACKGROUND_LINES])
                            most = max(best.values())
        rows = sorted(best.items(), key=lambda x: x[1])[:BACKGROUND_LINES]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["line", "h"])

    least = df.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(pick, "line string, h long").distinct().orderBy("h", "line").limit(BACKGROUND_LINES)
    return [r["line"] for r in least.collect()]


#: Models of this process by their names and background lines: queries over the same tables share a fit.
_FITTED: dict[tuple, Model] = {}


def fitted(df: DataFrame, names: DataFrame, text_col: str = "text") -> Model:
    """The model for a collection and a list of names (columns ``name`` and ``kind``, ``given`` or ``family``)."""
    listed = names.where("name is not null and kind in ('given', 'family')").select(F.trim("name").alias("name"), "kind").where("name <> ''").distinct()
    rows = listed.orderBy("kind", "name").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names; raise MAX_NAMES if the executors have room for them")
    by_kind = {k: sorted({r["name"] for r in rows if r["kind"] == k}) for k in ("given", "family")}
    lines = background_lines(df, text_col, {w.lower() for v in by_kind.values() for w in v})
    key = (tuple(by_kind["given"]), tuple(by_kind["family"]), tuple(lines), TRAIN_LINES, STEPS)
    if key not in _FITTED:
        if len(_FITTED) >= 4:
            _FITTED.clear()
        _FITTED[key] = fit(by_kind["given"], by_kind["family"], lines)
    return _FITTED[key]


def redact(df: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``<id>, redacted, entities array<struct<kind, start_char, end_char, found>>`` per row with a text.

    Placeholders are ``<EMAIL>``, ``<PHONE>``, ``<ID_NUMBER>``, ``<ADDRESS>`` and
    ``<PERSON>``; everything else stays as it is. Rows with a null id or text give
    nothing, empty texts come out empty; repeated rows are repeated. ``model``: one that
    ``fitted`` gave, else it is fitted to ``df`` and ``names``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fitted(df, names, text_col))
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type = base.schema["id"].dataType.simpleString()

    def apply(it):
        tagger = Tagger(shared.value)
        for batch in it:
            texts = batch.column("text").to_pylist()
            redacted, entities = [], []
            for text, spans in zip(texts, tagger.tag(texts)):
                out, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        out += [text[at:a], f"<{kind.upper()}>"]
                        at = b
                redacted.append("".join(out) + text[at:])
                entities.append([{"kind": k, "start_char": a, "end_char": b, "found": text[a:b]} for a, b, k in spans])
            kind_ = pa.struct([("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("found", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(redacted, pa.string()), pa.array(entities, pa.list_(kind_))], ["id", "redacted", "entities"])

    out = base.mapInArrow(apply, f"id {id_type}, redacted string, entities array<struct<kind string, start_char int, end_char int, found string>>")
    return out.withColumnRenamed("id", id_col)
