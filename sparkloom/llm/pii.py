"""Personal data and secrets by a skip-chain conditional random field.

The field's nodes are the tokens of a document that hold a digit or ``@``, those near a
cue (a title or the word name, a street word, a key word such as password), and all other
occurrences of such a value; every other token is fixed to label O, which cuts the chain
into runs and makes the cost follow the number of nodes. Neighbouring nodes share a chain
potential; distant nodes with the same text, or the same digits, share a skip potential,
so that a value recognised in one place is recognised in all. Loopy sum-product passing
over all documents of a batch at once gives the labels.

What has no cue anywhere in its document and no digit is not found: names in plain
prose, addresses without a street word, other identifiers than those of ``LABELS``.

Weights are trained here by pseudo-likelihood on annotated sentences from a seeded
generator (:func:`examples`).
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import append, col, fresh, pick

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN", "NAME", "ADDRESS")
JOINED = ("PHONE", "CARD", "IBAN", "NAME", "ADDRESS")  # values of several tokens
TOKEN = re.compile(r"[^\s぀-ヿ㐀-鿿豈-﫿＀-￯]+")
HOT = re.compile(r"[\d@]")
TRIM = ".,;:!?*&%$#|\"'`<>[]{}»«“”"
KEYWORD = re.compile(r"token|secret|passw|pwd|auth|bearer|credential|(?:^|[^a-z])(?:api|key)", re.I)
TITLES = frozenset("mr mrs ms miss mx dr prof herr frau señor señora sr sra monsieur madame mme mlle name nombre nom contact attn dear signed sincerely patient employee customer recipient".split())
STREETS = frozenset("street st avenue ave road rd lane ln boulevard blvd drive court square straße strasse str weg platz calle avenida plaza rue".split())
SECRETS = ("token", "secret", "passw", "pwd", "auth", "bearer", "credential", "api", "key")
_STREET = tuple(w + m for w in ("straße", "strasse") for m in ("", ".", ",", ":"))
_MARKS = ("", ".", ":", ",", "=", ".:")
CUES = frozenset(w + m for w in TITLES | STREETS for m in _MARKS)
STRONG = re.compile(r"passw|pwd|secret|token|credential", re.I)
CONTEXT = (
    re.compile(r"^(?:phone|tel|telephone|call|fax|mobile|cell)\W*$", re.I),
    re.compile(r"^(?:card|visa|mastercard|account|acct|iban|credit)\W*$", re.I),
    re.compile(r"^(?:ip|host|server|address)\W*$", re.I),
    re.compile(r"^(?:e-?mail|mail|contact)\W*$", re.I),
    re.compile(r"^(?:ssn|social)\W*$", re.I),
    re.compile(r"^(?:version|chapter|page|no\.?|number|section|item|year|in)\W*$", re.I),
)
SHAPES = (
    re.compile(r"[^@\s]+@[^@\s]+\.[^\W\d_]{2,}", re.I),
    re.compile(r".*@.*"),
    re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    re.compile(r"\d+"),
    re.compile(r"(?:\d[ -]?){12,18}\d"),
    re.compile(r"\d{3}[-.]\d{4}"),
    re.compile(r"\+\d{1,3}"),
    re.compile(r"\(\d{2,4}\)"),
    re.compile(r"\+?[\d(][\d().-]*[().-][\d().-]*\d"),
    re.compile(r"\+\d{8,14}"),
    re.compile(r"\d{3}-\d{2}-\d{4}"),
    re.compile(r"(?=.*\d)(?=.*[a-f])[0-9a-f]{24,}", re.I),
    re.compile(r"(?=.*\d)(?=.*[a-z])[\w+/=-]{16,}", re.I),
    re.compile(r"(?=.*\d)(?=.*[a-z])[\w+/=-]{8,15}", re.I),
    re.compile(r"(?:AKIA|ASIA|sk-|sk_|ghp_|gho_|xox|eyJ|AIza).{12,}"),
    re.compile(r"\w*(?:token|secret|passw\w*|pwd|key)\w*[=:].{6,}", re.I),
    re.compile(r"\d{1,2}(?:\.\d{1,2}){0,2}"),
    re.compile(r"(?:19|20)\d\d"),
    re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
    re.compile(r"\d{4}"),
    re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
    re.compile(r"[A-Z]{2}\d{2}"),
    re.compile(r"\d{1,4}[a-zA-Z]?"),
    re.compile(r"[^\W\d_a-zß-ÿ][^\W\d_A-ZÀ-Þ]+"),  # a capital, then small letters
    re.compile(r"[^\W\d_A-ZÀ-Þ]+"),  # small letters
    re.compile(r"[A-Z]\.?"),
    re.compile(r"[^\W\d_]{8,}"),
    re.compile(r"(?:[^\W\d_]+[-'’])+[^\W\d_]+"),
    re.compile(r"[^\W\d_]+"),
)
#: title just before; two before, after a capital; key word and = or : before; a street
#: word, one within three tokens, one just before, one just after; a number just before,
#: just after; among at least three groups of four digits; a title or street word itself;
#: a key word just before without = or :, and with it one that names nothing but secrets;
#: another occurrence of a value near a cue; a street word, a capital and a number that
#: stand as in an address.
NEAR = 17
COUNTS = ((1, 2), (3, 3), (4, 6), (7, 9), (10, 12), (13, 19), (20, 10**9))
FEATURES = 1 + len(SHAPES) + len(COUNTS) + 3 + len(CONTEXT) + NEAR


@dataclass(frozen=True)
class Field:
    """``rounds``: message-passing rounds at least; they go on until no message moves by
    ``still``, or ``most`` rounds, since loops may never settle; ``damping``: share of the old message kept;
    ``sentences``: size of the generated training set; ``seed``: of the generator."""

    rounds: int = 8
    damping: float = 0.3
    sentences: int = 3000
    seed: int = 11
    still: float = 1e-3
    most: int = 500


def cues(text: str) -> tuple[frozenset[str], bool]:
    """The titles and street words (with their marks) that a text holds, and whether it
    may hold a key word. Street words count where there is a number too."""
    low = text.lower()
    present = CUES.intersection(low.split())
    if present and not HOT.search(text):
        present = frozenset(w for w in present if _bare(w) in TITLES)
    return present, any(w in low for w in SECRETS)


@lru_cache(1 << 16)
def _shapes(core: str) -> tuple[int, ...]:
    """Features of a token by itself."""
    digits = sum(c.isdigit() for c in core)
    return (0, *(1 + i for i, r in enumerate(SHAPES) if r.fullmatch(core)), *(1 + len(SHAPES) + i for i, (a, b) in enumerate(COUNTS) if a <= digits <= b))


def _bare(s: str) -> str:
    return s.strip(TRIM + "=()").lower()


def cued(text: str, tokens: list[str], starts: list[int], hot: set[int]) -> tuple[set[int], ...]:
    """Numbers of the tokens near a cue, with all other occurrences of the capitalised or
    assigned ones of them; of titles, of street words, of key words, and of those others."""
    present, keys = cues(text)
    n, near, found = len(tokens), set(), set()
    title, street, key = set(), set(), set()
    low = [s.lower() for s in tokens] if present or "stra" in text else []
    for k, s in enumerate(low):
        if s in present:
            (title if _bare(s) in TITLES else street).add(k)
        elif s.endswith(_STREET):
            street.add(k)
    if keys:
        key.update(bisect_right(starts, m.start()) - 1 for m in KEYWORD.finditer(text))
        key.discard(-1)
    for k in title | key:
        near.update(range(k + 1, min(n, k + 4)))
    for k in street:
        if not hot.isdisjoint(range(k - 4, k + 4)):  # an address has a number
            near.update(range(max(0, k - 4), min(n, k + 4)))
    for k in near:
        core = tokens[k].strip(TRIM)
        if len(core) >= 4 and (core[:1].isupper() or (k and tokens[k - 1][-1:] in "=:")):
            found.add(core)
    echo = {k for k, s in enumerate(tokens) if s.strip(TRIM) in found} - near if found else set()
    return near | echo, title, street, key, echo


def nodes(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[int]]:
    """``(spans, features, token numbers)`` of the field's nodes."""
    spans, feats, numbers = [], [], []
    found = list(TOKEN.finditer(text))
    starts, tokens, n = [m.start() for m in found], [m.group() for m in found], len(found)
    hot = {bisect_right(starts, m.start()) - 1 for m in HOT.finditer(text)}
    near, title, street, key, echo = cued(text, tokens, starts, hot)
    at0 = 1 + len(SHAPES) + len(COUNTS)
    at1 = at0 + 3 + len(CONTEXT)
    num = lambda i: i in hot and tokens[i].strip(TRIM)[:1].isdigit()
    four = lambda i: i in hot and len(c := tokens[i].strip(TRIM)) == 4 and c.isdigit()
    for k in sorted(hot | near):
        s = tokens[k]
        core = s.strip(TRIM)
        if not core:
            continue
        lead = len(s) - len(s.lstrip(TRIM))
        before = ["", "", "", *tokens[max(0, k - 3) : k]][-3:]
        set_to = before[-1][-1:] in ("=", ":")
        f = list(_shapes(core))
        if s[:1] in "\"'`" or s[-1:] in "\"'`":
            f.append(at0)
        if set_to:
            f.append(at0 + 1)
        keyed = not key.isdisjoint(range(k - 3, k))
        if keyed:
            f.append(at0 + 2)
        f += [at0 + 3 + i for i, r in enumerate(CONTEXT) if r.match(before[-1]) or r.match(before[-2])]
        tests = (
            k - 1 in title, k - 2 in title and before[-1][:1].isupper(), keyed and any(w[-1:] in "=:" for w in before if w), k in street, not street.isdisjoint(range(k - 3, k + 4)),
            k - 1 in street, k + 1 in street, num(k - 1), num(k + 1), sum(map(four, range(k - 3, k + 4))) >= 3, k in title or k in street, k - 1 in key and not set_to,
            set_to and (k - 1 in key or k - 2 in key) and any(STRONG.search(w) for w in before[1:]), k in echo,
            k in street and any(map(num, (k - 3, k - 2, k - 1, k + 1, k + 2))),
            core[:1].isupper() and ((k + 1 in street or k + 2 in street) and (num(k - 1) or num(k - 2)) or k - 1 in street and (num(k + 1) or num(k - 2))),
            num(k) and (k + 2 in street and tokens[k + 1][:1].isupper() or k + 3 in street and tokens[k + 1][:1].isupper() and tokens[k + 2][:1].isupper() or k + 1 in street or k - 1 in street or k - 2 in street and before[-1][:1].isupper()),
        )
        f += [at1 + i for i, t in enumerate(tests) if t]
        spans.append((starts[k] + lead, starts[k] + lead + len(core)))
        feats.append(f)
        numbers.append(k)
    return spans, feats, numbers


def similar_key(s: str) -> tuple[bool, str] | None:
    """What a token has in common with those that it shares a skip potential with: its
    digits where it has no letters, else itself; None if that is too short to tell."""
    s = s.lower()
    digits = re.sub(r"\D", "", s)
    if len(digits) >= 7 and not re.search(r"[^\W\d_]", s):
        return True, digits
    return (False, s) if len(s) >= (4 if s.isalpha() else 6) else None


def edges(text: str, spans: list, numbers: list[int]) -> list[tuple[int, int, int]]:
    """``(node, node, kind)``: kind 0 joins neighbouring tokens, kind 1 an occurrence of
    a repeated or similar token with the next one, so that edges stay linear in number."""
    out, last = [], {}
    for i, (a, b) in enumerate(spans):
        if i and numbers[i] == numbers[i - 1] + 1:
            out.append((i - 1, i, 0))
        key = similar_key(text[a:b])
        if key:
            if key in last:
                out.append((last[key], i, 1))
            last[key] = i
    return out


def stars(texts: list[str], where: list[tuple[int, int, int, int]], unary: np.ndarray) -> tuple[list[tuple[int, int, int]], list[float]]:
    """``(links, shares)`` of kind 1 between the occurrences of each repeated value of a
    text and the one of them that is most surely no O, so that two hops join any two.
    Each of n others has a share of 1/n in what that one hears, lest many occurrences
    without context outvote the one that has it."""
    groups: dict[tuple, list[int]] = {}
    for k, (i, a, b, _) in enumerate(where):
        key = similar_key(texts[i][a:b])
        if key:
            groups.setdefault((i, *key), []).append(k)
    sure, links, shares = unary[:, 1:].max(axis=1) - unary[:, 0], [], []
    for own in groups.values():
        if len(own) > 1:
            hub = max(own, key=lambda k: sure[k])
            links += [(hub, k, 1) for k in own if k != hub]
            shares += [1 / (len(own) - 1)] * (len(own) - 1)
    return links, shares


def _word(r: random.Random) -> str:
    return "".join(r.choice(("an", "th", "er", "ou", "ing", "re", "de", "la", "que", "sch", "ion")) for _ in range(r.randint(1, 4)))


def _proper(r: random.Random) -> str:
    w = _word(r)
    return (w + _word(r) if len(w) < 4 else w).capitalize()


def _value(r: random.Random, label: str) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))
    if label == "EMAIL":
        return r.choice((f"{_word(r)}.{d(2)}@mail{d(1)}.example.com", f"{_word(r)}@{_word(r)}.{r.choice(('org', 'net', 'de', 'fr', 'es'))}", f"{_word(r)}_{_word(r)}+{d(1)}@{_word(r)}.co.uk"))
    if label == "PHONE":
        return r.choice((f"+{r.choice(('1', '44', '49', '33'))} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))
    if label == "IP":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if label == "CARD":
        return r.choice((d(16), d(16), d(15), "-".join(d(4) for _ in range(4)), " ".join(d(4) for _ in range(4))))
    if label == "IBAN":
        body = d(18)
        head = r.choice(("DE", "FR", "ES", "NL", "GB")) + d(2)
        return r.choice((head + body, head + r.choice(("ABNA", "BARC")) + d(14), " ".join([head, *(body[i : i + 4] for i in range(0, 18, 4))])))
    if label == "NAME":
        return r.choice((f"{_proper(r)} {_proper(r)}", f"{_proper(r)} {_proper(r)}", _proper(r), f"{r.choice('ABCDEJKLMR')}. {_proper(r)}", f"{_proper(r)}-{_proper(r)}"))
    if label == "ADDRESS":
        number, way = str(r.randint(1, 999)) + r.choice(("", "", "", "b")), r.choice(("Street", "St.", "Avenue", "Road", "Lane", "Blvd"))
        return r.choice((f"{number} {_proper(r)} {way}", f"{number} {_proper(r)} {_proper(r)} {way}", f"{_proper(r)} Straße {number}", f"{_proper(r).rstrip('.')}straße {number}", f"Calle {_proper(r)} {number}", f"{number} rue {_proper(r)}"))
    if label == "SSN":
        return f"{d(3)}-{d(2)}-{d(4)}"
    return r.choice((hexes(40), hexes(32), hexes(64), mixed(9), mixed(10), mixed(12), mixed(14), mixed(24), mixed(36), "AKIA" + mixed(16).upper(), "sk-" + mixed(32), "ghp_" + mixed(36), *(_word(r) + _word(r) + r.choice("xqw") for _ in range(3)), _word(r).capitalize() + _word(r).capitalize() + "q"))


def _noise(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice(
        (d(1), d(2), d(3), str(r.randint(1900, 2030)), f"{d(1)}.{d(1)}", f"{r.randint(1, 9)}.{d(1)}.{d(1)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}", f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{d(2)}%", f"{d(1)},{d(3)}", f"{d(3)},{d(3)}", f"${d(2)}", f"{_word(r)}{d(1)}", f"{d(1)}{_word(r)}", f"version {d(1)}", f"@{_word(r)}", f"{d(5)}", f"{d(6)}", f"{d(2)}:{d(2)}", f"{d(1)}-{_word(r)}", f"v{d(1)}.{d(1)}.{d(1)}", f"({d(4)})", f"{_proper(r)} {_word(r)}", f"{_proper(r)} {_word(r)}", f"the {r.choice(('key', 'secret', 'token', 'password', 'name', 'street', 'customer', 'patient', 'road'))} {r.choice(('of', 'is', 'was', 'that', _word(r)))} {_word(r)}",
         f"{r.choice(('dear', 'contact', 'drive', 'square', 'court', 'name'))} {_word(r)} {_word(r)}", f"{r.choice(('a key', 'the secret', 'their token'))} {_word(r)} {_word(r)}", f"the {_word(r)} street {_word(r)}", f"Mr {_word(r)}", f"{_proper(r)} {_proper(r)}", f"{d(4)} {d(4)}", f"key: {_word(r)} {_word(r)}" if r.random() < 0.3 else _word(r), f"{_word(r)}. St. {_word(r)} {d(2)}")
    )


def examples(p: Field) -> Iterable[tuple[str, list[tuple[int, int, int]]]]:
    """``(text, [(start, end, label)])`` of generated documents; values recur without
    their first context, as they do in real ones."""
    r = random.Random(p.seed)
    lead = {"EMAIL": ("mail", "contact", "email:"), "PHONE": ("call", "phone", "tel:"), "IP": ("host", "server", "ip"), "CARD": ("card", "account", "visa"), "SSN": ("ssn", "social"), "IBAN": ("iban", "IBAN:", "account"), "NAME": ("Mr", "Mrs.", "Dr.", "Herr", "Frau", "Name:", "name:", "Dear", "contact:", "Contact", "Sincerely,", "Patient:"), "ADDRESS": ("address:", "at", "lives at"), "SECRET": ("token =", "api_key =", "secret:", "password =", "key:")}
    for _ in range(p.sentences):
        text, gold, made = "", [], []
        for _ in range(r.randint(1, 7)):
            text += " ".join(_word(r) for _ in range(r.choice((0, 1, 2, 3, 4, 6)))) + r.choice((" ", " ", ", ", ".\n", " | "))
            x = r.random()
            if x < 0.4:
                text += _noise(r) + r.choice((" ", ". ", ", ", "!! "))
                continue
            if made and x < 0.65:
                value, label = r.choice(made)
            else:
                label = r.choice(LABELS[1:])
                value = _value(r, label)
                made.append((value, label))
                if label in ("SECRET", "NAME") or r.random() < 0.3:
                    weak = label != "SECRET" or not value.isalpha()
                    text += r.choice(lead[label] if weak else ("token =", "secret:", "password =", "password:", "pwd =")) + " "
            quote = '"' if label == "SECRET" and r.random() < 0.6 else ""
            text += quote
            gold.append((len(text), len(text) + len(value), LABELS.index(label)))
            text += value + quote + r.choice((" ", ". ", ", ", "\n", "!! "))
        yield text, gold


def train(p: Field) -> tuple[np.ndarray, np.ndarray]:
    """``(unary [features, labels], pair [kind, labels, labels])`` that maximise the
    penalised pseudo-likelihood, by full-batch gradient steps with momentum, scaled by
    how often a feature occurs."""
    rows, ys, us, vs, kinds, base = [], [], [], [], [], 0
    for text, gold in examples(p):
        spans, feats, numbers = nodes(text)
        rows += feats
        ys += [next((l for s, e, l in gold if a < e and s < b), 0) for a, b in spans]
        for u, v, k in edges(text, spans, numbers):
            us.append(base + u), vs.append(base + v), kinds.append(k)
        base += len(spans)
    X, y, L = np.zeros((len(rows), FEATURES)), np.array(ys), len(LABELS)
    for i, f in enumerate(rows):
        X[i, f] = 1
    Y = np.eye(L)[y]
    src, dst, kind = np.array(us + vs), np.array(vs + us), np.array(kinds + kinds)
    N = np.zeros((2, len(y), L))  # labels of each node's neighbours, by kind of edge
    np.add.at(N, (kind, dst), Y[src])
    Z = np.concatenate([X, N[0], N[1]], axis=1)
    prior = np.concatenate([np.zeros((FEATURES, L)), 0.3 * np.eye(L), 2.0 * np.eye(L)])
    w, m = prior.copy(), np.zeros_like(prior)
    scale = 1 / (Z.mean(axis=0) + 0.003)[:, None]  # rare features take longer steps
    for _ in range(300):
        q = Z @ w
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        g = Z.T @ (q - Y) / len(y) + 3e-5 * (w - prior)
        m = 0.9 * m + g * scale
        w -= 0.03 * m
    pair = np.stack([w[FEATURES : FEATURES + L], w[FEATURES + L :]])
    return w[:FEATURES], (pair + pair.transpose(0, 2, 1)) / 2


@lru_cache(4)
def model(p: Field = Field()) -> tuple[np.ndarray, np.ndarray]:
    return train(p)


def marginals(unary: np.ndarray, links: np.ndarray, pair: np.ndarray, p: Field, shares: np.ndarray | None = None) -> np.ndarray:
    """Label marginals by loopy sum-product with flooding; exact where edges form trees.

    ``shares``: weight of each link's message to its first node, 1 where not given."""
    if not len(links):
        b = np.exp(unary - unary.max(axis=1, keepdims=True))
        return b / b.sum(axis=1, keepdims=True)
    e = len(links)
    src = np.concatenate([links[:, 0], links[:, 1]])
    dst = np.concatenate([links[:, 1], links[:, 0]])
    w = pair[np.concatenate([links[:, 2], links[:, 2]])]
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    m = np.zeros((2 * e, unary.shape[1]))
    part = np.concatenate([np.ones(e), np.ones(e) if shares is None else shares])[:, None]
    for k in range(max(p.rounds, p.most)):
        total = unary.copy()
        np.add.at(total, dst, m)
        cavity = (total[src] - m[back])[:, :, None] + w
        top = cavity.max(axis=1)
        new = top + np.log(np.exp(cavity - top[:, None, :]).sum(axis=1))
        new = (new - new.max(axis=1, keepdims=True)) * part
        moved = np.abs(new - m).max()
        m = p.damping * m + (1 - p.damping) * new
        if k + 1 >= p.rounds and moved < p.still:
            break
    total = unary.copy()
    np.add.at(total, dst, m)
    b = np.exp(total - total.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def find(texts: list[str | None], weights: tuple[np.ndarray, np.ndarray], p: Field = Field()) -> list[list[tuple[int, int, str]]]:
    """Spans ``(start, end, label)`` in each text, neighbouring parts of one value joined."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    feats, links, where = [], [], []
    for i, t in enumerate(texts):
        if not t or not (HOT.search(t) or any(cues(t))):
            continue
        spans, f, numbers = nodes(t)
        links += [(len(feats) + u, len(feats) + v, k) for u, v, k in edges(t, spans, numbers) if k == 0]
        feats += f
        where += [(i, a, b, n) for (a, b), n in zip(spans, numbers)]
    if not feats:
        return out
    w, pair = weights
    unary = np.stack([w[f].sum(axis=0) for f in feats])
    more, shares = stars(texts, where, unary)
    every = np.array(links + more, np.int64).reshape(-1, 3)
    label = marginals(unary, every, pair, p, np.array([1.0] * len(links) + shares)).argmax(axis=1)
    before = (-1, -9, 0)
    for (i, a, b, n), l in zip(where, label):
        if l:
            if before == (i, n - 1, l) and LABELS[l] in JOINED and (LABELS[l] not in ("CARD", "IBAN") or b - a <= 4):
                out[i][-1] = (out[i][-1][0], b, LABELS[l])
            else:
                out[i].append((a, b, LABELS[l]))
        before = (i, n, l)
    return [[y for x in own if (y := x if x[2] != "ADDRESS" else _numbered(texts[i], x))] for i, own in enumerate(out)]


_HOUSE = (re.compile(r"(?<!\S)\d{1,4}[a-zA-Z]?,?\s+$"), re.compile(r"[,.]?\s+\d{1,4}[a-zA-Z]?(?!\w)"))


def _numbered(text: str, span: tuple[int, int, str]) -> tuple[int, int, str] | None:
    """An address with its house number, which stands in it, before it or after it; None
    if there is none, since it is no address then."""
    a, b, label = span
    if any(c.isdigit() for c in text[a:b]):
        return span
    if m := _HOUSE[0].search(text[max(0, a - 8) : a]):
        return a - len(m.group()), b, label
    m = _HOUSE[1].match(text[b : b + 8])
    return (a, b + m.end(), label) if m else None


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its label in square brackets."""
    parts, at = [], 0
    for a, b, l in spans:
        parts += [text[at:a], f"[{l}]"]
        at = b
    return "".join(parts) + text[at:]


def _applied(docs: DataFrame, text: str, to: str, spans: str, p: Field) -> DataFrame:
    weights, at = docs.sparkSession.sparkContext.broadcast(model(p)), docs.columns.index(text)

    def run(b):
        texts = pa.compute.cast(b.column(at), pa.string()).to_pylist()
        found = find(texts, weights.value, p)
        return [
            pa.array([t if not s else masked(t, s) for t, s in zip(texts, found)], pa.string()),
            pa.array([[f"{a}-{b} {l}" for a, b, l in s] for s in found], pa.list_(pa.string())),
        ]

    return append(docs, run, **{to: "string", spans: "array<string>"})


def scan(docs: DataFrame, p: Field = Field()) -> DataFrame:
    """``doc_id, text, spans`` of every document: the text with personal data masked, and
    ``start-end LABEL`` for each masked value, in characters of the text as it came.

    A null text stays null and an empty one empty, without spans. Texts of any length
    are read wholly. Equal texts have equal spans; of labels with equal marginals the
    first of ``LABELS`` is taken. Repeated rows give repeated rows; other columns are left
    aside. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string")
    return _applied(d, "text", "masked", "spans", p).select("doc_id", F.col("masked").alias("text"), "spans")


def redacted(docs: DataFrame, p: Field = Field()) -> DataFrame:
    """The documents with personal data masked in ``text`` (and ``n_chars``, where there
    is one, the length of the new text); other columns as they came. A null text stays
    null; an empty table gives an empty result."""
    to, spans = fresh(docs, "masked", "spans")
    own = next(c for c in docs.columns if c.lower() == "text")
    out = _applied(docs, own, to, spans, p)
    new = {"text": F.col(to), "n_chars": F.when(F.col(to).isNotNull(), F.length(to)).otherwise(F.lit(None))}
    return out.select(*[new[c.lower()].cast(docs.schema[c].dataType).alias(c) if c.lower() in new else col(c) for c in docs.columns])
