"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) are scanned over whole texts, leftmost and without overlap within a kind; a match
that fails its check is dropped and not tried again. Their spans always stay.

The field labels segments, not tokens. A text's tokens are runs of letters, runs of digits and single other characters.
A segment is a candidate for a kind only where it has that kind's own form and begins and ends at tokens: four numbers up to
255; a run of 13 to 19 digits with a checksum, next to one other of that length at most, or to such only, or groups of digits with a checksum
that stand alone (as the pattern has them) or after a word for a card; +, or three digits in brackets, or after a word for a telephone any groups, with digits as a phone
number has; @ between a name and a domain; after a word for a key a whole
run of letters, digits, _ and -, of 16 characters or more, for `secret`. Numbers in tables, years, dates and coordinates have none of these forms. Whole-span features (shape, digit count, checksum,
alphabet, separators, the words just before) score each candidate, and the bounded-entity dynamic programme picks the best
joint choice of boundaries and kinds; tokens outside entities score 0. Candidates are few, so a text costs about its length.
Weights are fitted here, by gradient ascent on the conditional log likelihood (forward recursion over segments) of texts
that a seeded generator makes: entities, near misses and prose. Entities of the four kinds or `secret` (access tokens) that
overlap no base span of whatever kind are added; a secret also stands over base spans that lie inside it.

Defined results: null counts as empty and has no span; offsets are code points, end exclusive; ties in the programme go to
fewer and then to earlier segments; repeated rows get equal results; an empty table gives an empty result. Work is linear
in the text: a token begins at most MAX_TOKENS candidates, an @ MAX_TOKENS squared.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.runtime import tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four patterns by kind, each in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out["email"].append((begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(_small(x) for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then in the order of kinds."""
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


# The segment model

LABELS = (*KINDS, "secret")
#: Most tokens in a segment of each kind; a secret is a whole run of key characters, however long.
MAX_TOKENS = {"email": 16, "ip": 7, "card": 9, "phone": 12}
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
_KEY = re.compile(r"(?i)(token|secret|key|password|passwd|pwd|api)\W{0,6}$")
_CALL = re.compile(r"(?i)\b(tel|phone|call|fax|mobile|tél|telefon|teléfono)\W{0,4}$")
_CARD_WORD = re.compile(r"(?i)\b(card|visa|mastercard|amex|karte|carte|tarjeta)\W{0,4}(no|nr|number)?\W{0,4}$")
_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_FORM = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_PHONE_FORM = re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?([ .-][0-9]{2,4}){1,4}")
_ROUND_FORM = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}")
_HEX = re.compile(r"[0-9a-fA-F]+")
#: All characters that any of the whole-span forms has.
_IN_FORM = re.compile(r"[0-9A-Za-z._%+@ ()-]+")
_WORDY = re.compile(r"[0-9A-Za-z_-]+")


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b] that any kind may weigh."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    before, after = text[max(0, a - 24) : a], text[b : b + 1]
    n, letters = len(digits), sum(c.isalpha() for c in s)
    out = ["bias", f"digits:{min(n, 20) if n > 7 else 'few'}", f"chars:{min(len(s).bit_length(), 8)}"]
    out.append("mixed" if n and letters else "digits only" if not letters else "no digit")
    if _EMAIL_FORM.fullmatch(s):
        out.append("form:email")
    if _IP_FORM.fullmatch(s):
        out.append("form:ip:" + ("ok" if all(_small(x) for x in s.split(".")) else "big"))
    if _PHONE_FORM.fullmatch(s) and 7 <= n <= 15:
        out.append("form:phone:" + ("plus" if s[0] == "+" else "round" if "(" in s else "plain"))
    if not letters and 12 <= n <= 19 and _CARD.fullmatch(s):
        out.append("form:card:" + ("luhn" if luhn(digits) else "fails"))
    if len(s) >= 16 and _WORDY.fullmatch(s) and n >= 3 and letters >= 3:
        out.append("form:key:" + ("hex" if _HEX.fullmatch(s.strip("-")) else "word"))
    if _KEY.search(before):
        out.append("after:key")
    if _CALL.search(before):
        out.append("after:call")
    if _CARD_WORD.search(before):
        out.append("after:card")
    if before[-1:].isalnum() or before[-1:] in ("@", "+", "_") or (before[-1:] in (".", "-") and before[-2:-1].isalnum()):
        out.append("cut:left")
    if after.isalnum() or after in ("@", "_") or (after in (".", "-") and text[b + 1 : b + 2].isalnum()):
        out.append("cut:right")
    if any(c.isspace() for c in s) and letters:
        out.append("blank")
    return out


def _clusters(text: str) -> Iterator[tuple[list[tuple[int, int]], list[bool]]]:
    """Stretches of tokens in which a segment may hold a trigger, and which of the tokens are triggers.

    A stretch ends where no segment can reach from one trigger's word to the next: words stand whole, as entities do not
    begin or end inside a run of letters or digits, and blanks inside one occur only between digits and brackets. It also
    ends at each token with a character that no whole-span form has. Nothing else ends it, however long it is.
    """
    last = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < last:
            continue
        a = m.start()
        while a > last and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text):
            if not text[b].isspace():
                b += 1
            elif text[b] == " " and b + 1 < len(text) and (text[b + 1].isdigit() or text[b + 1] in "(+"):
                b += 1
            else:
                break
        last = b
        tokens: list[tuple[int, int]] = []
        trigger: list[bool] = []
        for x in _TOKEN.finditer(text, a, b):
            if _IN_FORM.fullmatch(x.group()):
                tokens.append(x.span())
                trigger.append(x.group()[0] in "0123456789@")
            elif tokens:
                if any(trigger):
                    yield tokens, trigger
                tokens, trigger = [], []
        if any(trigger):
            yield tokens, trigger


def _context(text: str, a: int) -> str:
    return text[max(0, a - 24) : a]


def _apart(text: str, a: int, b: int, more: str) -> bool:
    """Whether text[a:b] isn't part of something longer that goes on with a letter, a digit or one of `more` and a digit."""
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    left = before[-1:].isalnum() or (before[-1:] and before[-1:] in more and before[:1].isdigit())
    return not left and not after[:1].isalnum() and not (after[:1] and after[:1] in more and after[1:].isdigit())


def _numbers(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first token, end token, kind) of the candidates of digits: ip, card, phone."""
    n = len(tokens)
    digit = [text[a] in "0123456789" for a, _ in tokens]
    long_end, long_good = 0, False
    for i, (a, b) in enumerate(tokens):
        c = text[a]
        if digit[i]:
            if b - a <= 3 and i + 7 <= n and digit[i + 2] and text[b] == "." and _apart(text, a, tokens[i + 6][1], "."):
                s = text[a : tokens[i + 6][1]]
                if _IP_FORM.fullmatch(s) and all(_small(x) for x in s.split(".")):
                    yield i, i + 7, "ip"
            if 12 < b - a < 20 and _apart(text, a, b, ".,+"):
                if i >= long_end:  # the run of numbers that this one stands in
                    long_end, groups = i, []
                    while long_end < n and digit[long_end]:
                        groups.append(text[tokens[long_end][0] : tokens[long_end][1]])
                        long_end += 2 if long_end + 2 < n and digit[long_end + 2] and text[tokens[long_end][1]] in " -" else 1
                    large = [g for g in groups if len(g) > 4]
                    long_good = all(12 < len(g) < 20 for g in large) and (len(large) < 3 or all(map(luhn, large))) and len(groups) - len(large) < 3
                if long_good and luhn(text[a:b]):
                    yield i, i + 1, "card"
            elif b - a < 8:
                whole, named = i < 2 or not digit[i - 2] or text[a - 1] not in " -", bool(_CARD_WORD.search(_context(text, a)))
                j, held = i + 1, b - a
                while (whole or named) and j + 1 < n and j - i < MAX_TOKENS["card"] - 1 and text[tokens[j][0]] in " -" and digit[j + 1]:
                    held, j = held + tokens[j + 1][1] - tokens[j + 1][0], j + 2
                    ends = j + 1 >= n or text[tokens[j][0]] not in " -" or not digit[j + 1]
                    if (named or ends) and 12 <= held <= 19 and _apart(text, a, tokens[j - 1][1], ".") and luhn(_NOT_DIGIT.sub("", text[a : tokens[j - 1][1]])):
                        yield i, j, "card"
        if c in "+(" or digit[i]:
            round_form = _ROUND_FORM.match(text, a) if c == "(" else None
            call = c != "+" and bool(_CALL.search(_context(text, a)))
            if (c == "+" or round_form or call) and not (i and digit[i - 1]):
                for j in range(i + 1, min(n, i + MAX_TOKENS["phone"]) + 1):
                    x, y = tokens[j - 1]
                    if not (digit[j - 1] or text[x] in "+ .-()"):
                        break
                    if digit[j - 1] and (c == "+" or call or y == round_form.end()):
                        s = text[a:y]
                        if _PHONE_FORM.fullmatch(s) and (9 if c == "+" else 7) <= sum(q - p for (p, q), d in zip(tokens[i:j], digit[i:j]) if d) <= 15:
                            yield i, j, "phone"


def _addresses(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    most = MAX_TOKENS["email"]
    for at, (a, _) in enumerate(tokens):
        if text[a] == "@":
            first = at
            while first > max(0, at - most) and all(c in _LOCAL_SET for c in text[tokens[first - 1][0] : tokens[first - 1][1]]):
                first -= 1
            last = at + 1
            while last < min(len(tokens), at + most) and text[tokens[last][0]] in _LOCAL_SET and text[tokens[last][0]] not in "_%+":
                last += 1
            for i in range(first, at):
                for j in range(at + 4, min(last, i + most) + 1):
                    if _EMAIL_FORM.fullmatch(text, tokens[i][0], tokens[j - 1][1]):
                        yield i, j, "email"


def _keys(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Whole runs of key characters, with and without the dashes at either end."""
    i, n = 0, len(tokens)
    while i < n:
        end = i
        while end < n and _WORDY.fullmatch(text, *tokens[end]):
            end += 1
        if end > i and tokens[end - 1][1] - tokens[i][0] >= 16:
            bare, first = end, i
            while bare > i and text[tokens[bare - 1][0]] == "-":
                bare -= 1
            while first < bare and text[tokens[first][0]] == "-":
                first += 1
            for a in sorted({i, first}):
                for b in sorted({bare, end}):
                    if a < b:
                        yield a, b, "secret"
        i = max(end, i + 1)


def _segments(text: str, tokens: list[tuple[int, int]], trigger: list[bool]) -> Iterator[tuple[int, int, str, list[str]]]:
    """(first token, end token, kind, features) of a stretch's candidates, each of its kind's own form, by first token."""
    found = [*_numbers(text, tokens), *_addresses(text, tokens), *_keys(text, tokens)]
    for i, j, kind in sorted(set(found)):
        f = segment_features(text, tokens[i][0], tokens[j - 1][1])
        if kind != "secret" or ("after:key" in f and any(x.startswith("form:key") for x in f)):
            yield i, j, kind, f


class SemiMarkov:
    """Weights by (kind, feature), and the two recursions over segments."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in features)

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for tokens, trigger in _clusters(text):
            # The best score and least number of segments up to token `at`; by end, the best that ends in a segment still
            # ahead; and of the ends where a segment won, how. Nothing is kept of the candidates themselves.
            at, top = 0, (0.0, 0)
            ahead: dict[int, tuple[tuple[float, int], int, str]] = {}
            came: dict[int, tuple[int, str]] = {}
            for i, j, kind, f in _segments(text, tokens, trigger):
                if i > at:
                    at, top = i, self._reach(i, top, ahead, came)
                got = top[0] + self.score(kind, f), top[1] - 1
                if j not in ahead or got > ahead[j][0]:
                    ahead[j] = got, i, kind
            self._reach(len(tokens), top, ahead, came)
            j = len(tokens)
            while j:
                i, kind = came.get(j, (j - 1, None))
                if kind:
                    out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return sorted(out, key=lambda s: s[1])

    @staticmethod
    def _reach(to: int, top: tuple[float, int], ahead: dict, came: dict) -> tuple[float, int]:
        """The best up to token `to`, where all candidates that end there are known."""
        for j in sorted(x for x in ahead if x <= to):
            got, i, kind = ahead.pop(j)
            if got > top:
                top, came[j] = got, (i, kind)
        return top

    def gradient(self, stretches: list) -> dict[tuple[str, str], float]:
        """The gradient of the log likelihood of the true segments, by the forward and backward recursions."""
        slope: dict[tuple[str, str], float] = {}
        for n, ends in stretches:
            scored = {j: [(i, kind, self.score(kind, f), f, right) for i, kind, f, right in group] for j, group in ends.items()}
            ahead, behind = [0.0] * (n + 1), [-math.inf] * n + [0.0]
            for j in range(1, n + 1):
                terms = [ahead[j - 1], *(ahead[i] + s for i, _, s, _, _ in scored.get(j, ()))]
                top = max(terms)
                ahead[j] = top + math.log(sum(math.exp(t - top) for t in terms))
            for j in range(n, 0, -1):
                for i, s in [(j - 1, 0.0), *((i, s) for i, _, s, _, _ in scored.get(j, ()))]:
                    x, y = behind[i], behind[j] + s
                    behind[i] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
            for j, group in scored.items():
                for i, kind, s, f, right in group:
                    g = right - math.exp(ahead[i] + s + behind[j] - ahead[n])
                    if abs(g) > 1e-6:
                        for x in f:
                            slope[kind, x] = slope.get((kind, x), 0.0) + g
        return slope

    def stretches(self, text: str, truth: set[tuple[str, int, int]]) -> list:
        """For training: each stretch's number of tokens, and its candidates by their end, with whether they are true."""
        out = []
        for tokens, trigger in _clusters(text):
            ends: dict[int, list] = {}
            for i, j, kind, f in _segments(text, tokens, trigger):
                ends.setdefault(j, []).append((i, kind, f, (kind, tokens[i][0], tokens[j - 1][1]) in truth))
            if ends:
                out.append((len(tokens), ends))
        return out


def training_texts(rows: int = 120, seed: int = 7) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Generated texts with their entities. Near misses (versions, dates, failing checksums, plain numbers) are not."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeionrstldmu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        x = number(r.choice([12, 14, 15, 15, 15, 17]))
        x += next(c for c in "0123456789" if luhn(x + c))
        return x if r.random() < 0.6 else r.choice(" -").join(x[i : i + 4] for i in range(0, len(x), 4))

    def bad_card() -> str:
        x = number(r.choice([13, 15, 15, 16]))
        return x + next(c for c in "0123456789" if not luhn(x + c))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)}-{a}-{b}-{c}"])

    def secret() -> str:
        alphabet = r.choice(["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGH"])
        return "".join(r.choice(alphabet) for _ in range(r.choice([24, 32, 40, 40, 40]))) + "a1b2c3"[: r.choice([0, 6])]

    make = {
        "email": lambda: f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.{r.choice(['com', 'org', 'de'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card, "phone": phone, "secret": secret,
    }
    miss = [lambda: f"{r.randint(1, 20)}.{r.randint(0, 9)}.", lambda: f"{number(4)}-{number(2)}-{number(2)}", bad_card, lambda: number(r.randint(1, 8)), lambda: f"{number(3)}.{r.randint(256, 999)}.{number(2)}.{number(3)}", lambda: f"{word()}@{word()}", lambda: f"{number(3)}-{number(4)}", lambda: word() + number(2), secret, lambda: " ".join(str(1900 + r.randint(0, 120)) for _ in range(r.randint(2, 6))), lambda: " ".join(number(r.randint(1, 6)) for _ in range(r.randint(2, 9))), lambda: f"{number(2)}.{number(5)}, -{number(2)}.{number(5)}"]
    out = []
    for _ in range(rows):
        text, truth = "", set()
        for _ in range(r.randint(2, 6)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
            kind = r.choice(LABELS)
            if r.random() < 0.65:
                quote = ""
                if kind == "secret":
                    quote = r.choice(['"', "", "'"])
                    text += r.choice(["token = ", "api_key: ", "secret=", "password: ", "TOKEN = "]) + quote
                elif kind == "phone" and r.random() < 0.3:
                    text += "tel "
                x = make[kind]()
                truth.add((kind, len(text), len(text) + len(x)))
                text += x + quote
            else:
                text += r.choice(miss)()
            text += r.choice([" ", ". ", ", ", "### ", "!! ", "\n"])
        out.append((text, truth))
    return out


def fit(rounds: int = 15, rate: float = 0.5, decay: float = 0.002) -> SemiMarkov:
    """Adagrad on the generated texts; deterministic."""
    model, squares = SemiMarkov(), {}
    texts = [model.stretches(text, truth) for text, truth in training_texts()]
    for _ in range(rounds):
        for at in range(0, len(texts), 16):
            slope = model.gradient([x for t in texts[at : at + 16] for x in t])
            for k, g in slope.items():
                g -= decay * model.weights.get(k, 0.0)
                squares[k] = squares.get(k, 1e-3) + g * g
                model.weights[k] = model.weights.get(k, 0.0) + rate * g / math.sqrt(squares[k])
    return model


def find(text: str | None, model: SemiMarkov) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and what the model adds."""
    text = text or ""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, []
    taken = sorted(s for spans in base.values() for s in spans)
    ends = [0]
    for _, b in taken:
        ends.append(max(ends[-1], b))
    added = []
    for kind, a, b in model.decode(text):
        # Spans that begin before b reach at most the running maximum of their ends.
        last = bisect_left(taken, (b, 0))
        if ends[last] <= a or (kind == "secret" and ends[last] <= b and all(x >= a for x, y in taken[:last] if y > a)):
            added.append((kind, a, b))
    return base, added


def scan(df: DataFrame, text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and masked (each span as <KIND>)."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit())
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"]
    kept = [c for c in df.columns if c not in new]
    place = kept.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in new]
            for value in batch.column(place):
                value = value.as_py()
                base, added = find(value, known)
                own = [(k, a, b) for k in KINDS for a, b in base[k]]
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(joined(own).encode()).hexdigest(), joined(own + added), masked(value, own + added)]
                for c, x in zip(columns, row):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], [*kept, *new])

    return df.select(*kept).mapInArrow(tidy(run), f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or group of overlapping spans, replaced by <KIND> of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every document."""
    return scan(documents.select("doc_id", "text")).drop("text", "masked")
