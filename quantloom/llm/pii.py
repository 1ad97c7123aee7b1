"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns' valid matches; per kind they are leftmost and do not overlap.

    An address is found from its @: the local part is the longest run before it that an earlier match leaves free. An IP
    match starts where a run of digits starts. Both say what the plain search says, in linear time.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# --- the conditional random field ------------------------------------------------------------------------------------

#: What the field finds: of the base kinds those that have other forms, and secrets, which have no base pattern.
FIELD_KINDS = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in ("email", "card", "phone", "secret") for p in "BI"))
FEATURES = 1 << 13
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\w\s]|_", re.ASCII)
#: Spaces, dashes and dots beyond ASCII, each read as its plain sign.
PLAIN = {**dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " "), **dict.fromkeys([*range(0x2010, 0x2016), 0x2212, 0xFE63, 0xFF0D], "-"), **dict.fromkeys([0xB7, 0x2022, 0x2024, 0x2027, 0x2219, 0x22C5, 0x30FB, 0xFF0E], "."), 0xFF20: "@", 0xFE6B: "@"}
UNPLAIN = re.compile("[" + "".join(map(re.escape, map(chr, PLAIN))) + "]")
#: What can hold a label: seven digits or more with any separators, and the words around every at and @ that a dot follows,
#: for an added address holds both. A text falls into windows around these, and no other token gets a label.
NUMBER = re.compile(r"(?<![A-Za-z0-9])[(+]?[0-9](?>(?:[^\w\r\n]|_)*+[0-9]){6,}(?![A-Za-z0-9])")
AT = re.compile(r"(?<![A-Za-z0-9])at(?![A-Za-z0-9])|@", re.I)
DOT = re.compile(r"(?<![A-Za-z0-9])dot(?![A-Za-z0-9])|\.[)\]}>]?[A-Za-z0-9]|[\s(\[{<]\.[)\]}>]?\s?[A-Za-z0-9]", re.I)
#: An address that the field finds is taken whole, as far as it is written like this.
SPOKEN = r"(?:[A-Za-z0-9]{1,64} (?:dot|underscore|dash) ){0,3}"
ADDRESS = re.compile(SPOKEN + r"[A-Za-z0-9_.%+-]{1,64} ?[(\[{<]? ?(?:@|(?<![A-Za-z0-9])at(?![A-Za-z0-9])) ?[)\]}>]? ?[A-Za-z0-9-]{1,63}(?:(?: \. [A-Za-z0-9-]{1,63})+|(?: ?[(\[{<]? ?(?:\bdot\b) ?[)\]}>]? ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+)", re.I)
#: What announces a secret; its window reaches to the end of the next run that could be one.
KEYED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]{1,20}[_-])?(?:token|key|apikey|secret|password|passwd|pwd|bearer|credential)s?(?![A-Za-z])[^A-Za-z0-9\r\n]{1,8}(?:is[^A-Za-z0-9\r\n]{1,4})?(?=[A-Za-z0-9_+/=.-]{8})", re.I)
SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{1,200}")
#: Characters before and after an at, to the end of the word there but at most LONGEST.
BEFORE, AFTER, LONGEST = 40, 56, 120
#: Tokens on either side of a window that its features see.
CONTEXT = 4
#: Tokens of the windows that are decoded together, padded to the longest.
CELLS = 100_000


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{len(token)}"
    if token.isalpha():
        return ("X" if token[0].isupper() else "x") + ("X" if token[1:].isupper() and len(token) > 1 else "x" if len(token) > 1 else "")
    return token


#: Words that say what a number near them is.
CUES = {
    "phone": frozenset("tel tél telefon telephone téléphone teléfono phone call ring fax mobile móvil cell handy number rufnummer reach dial text whatsapp appelez llame".split()),
    "card": frozenset("card cards visa mastercard amex credit debit karte kreditkarte carte tarjeta paid pay expires".split()),
    "other": frozenset("order invoice serial serie isbn version id ref code build iban account ticket page pages year years total sum price row rows lat lon value values score scores section".split()),
}


def cues_of(text: str, a: int, b: int) -> list[str]:
    """The kinds of cue words in and shortly around a window."""
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, a - 40) : b + 24])}
    return [f"cue{k}" for k, of in CUES.items() if not words.isdisjoint(of)]


def runs_of(text: str, a: int, b: int) -> list[tuple[int, int, list[str]]]:
    """The window's long numbers: where, and how many digits they have and whether these pass the cards' check."""
    out = []
    for m in NUMBER.finditer(text, a, b):
        digits = re.sub(r"\D", "", m[0]) if len(m[0]) <= 200 else "0" * 40
        out.append((m.start(), m.end(), [f"n{min(len(digits), 20)}", f"luhn{14 <= len(digits) <= 19 and luhn(digits)}"]))
    return out


def features(tokens: list[str], gaps: list[bool], k: int, tags: list[str]) -> list[int]:
    """Word-shape features of a token: its own and its neighbours' shapes and words, white space before it, and what is told of the
    number that it is in."""
    get = lambda j: tokens[j] if 0 <= j < len(tokens) else "<>"
    named = [*tags, f"b{gaps[k]}", f"w{get(k).lower()[:12]}" if not get(k).isdigit() else f"first{get(k)[0]}"]
    for j in range(-3, 4):
        named.append(f"s{j}{shape(get(k + j))}")
        if j and get(k + j).isalpha():
            named.append(f"w{j}{get(k + j).lower()[:12]}")
    named += [f"s-{shape(get(k - 1))}{shape(get(k))}", f"s+{shape(get(k))}{shape(get(k + 1))}", f"t{shape(get(k - 1))}{shape(get(k))}{shape(get(k + 1))}"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in named]


@dataclass
class Chain:
    """Weights: feature x label, label x label (from, to), and the first label's."""

    unary: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def _scores(rows: list[list[list[int]]], unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded label scores (window, place, label) and the windows' lengths."""
    sizes = np.array([len(r) for r in rows])
    flat = [f for r in rows for f in r]
    counts = np.array([len(f) for f in flat])
    ids = np.fromiter((i for f in flat for i in f), np.int64, int(counts.sum()))
    sums = np.add.reduceat(unary[ids], np.concatenate(([0], np.cumsum(counts)[:-1])))
    out = np.zeros((len(rows), sizes.max(), unary.shape[1]))
    out[np.arange(sizes.max()) < sizes[:, None]] = sums
    return out, sizes


def viterbi(rows: list[list[list[int]]], chain: Chain) -> list[list[int]]:
    """The best label sequence of each window, all windows of a batch at once."""
    s, sizes = _scores(rows, chain.unary)
    n, most, _ = s.shape
    best, back = chain.first + s[:, 0], []
    for t in range(1, most):
        through = best[:, :, None] + chain.moves
        back.append(through.argmax(1))
        new = through.max(1) + s[:, t]
        best = np.where((t < sizes)[:, None], new, best)
    path = np.zeros((n, most), np.int64)
    last = best.argmax(1)
    for t in range(most - 1, -1, -1):
        path[:, t] = last
        if t:
            last = np.where(t < sizes, back[t - 1][np.arange(n), last], last)
    return [p[:k].tolist() for p, k in zip(path, sizes, strict=True)]


def decoded(rows: list[list[list[int]]], chain: Chain) -> list[list[int]]:
    """Viterbi over windows of like length together, so that a long one does not lengthen all."""
    out: list[list[int]] = [[] for _ in rows]
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(rows[order[end]]) <= CELLS:
            end += 1
        for k, path in zip(order[at:end], viterbi([rows[k] for k in order[at:end]], chain), strict=True):
            out[k] = path
        at = end
    return out


def train(rows: list[list[list[int]]], labels: list[list[int]], steps: int = 45) -> Chain:
    """Maximum likelihood with a small quadratic penalty, by Adam on the whole table. Sums over paths go forward and back in scaled
    probabilities, over the windows that are so long alone."""
    n_labels = len(LABELS)
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
    rows, labels = [rows[k] for k in order], [labels[k] for k in order]
    sizes = np.array([len(r) for r in rows])
    n, most = len(rows), sizes.max()
    inside = np.arange(most) < sizes[:, None]
    left = inside.sum(0).tolist()  # windows that reach each place
    gold = np.concatenate([np.array(y) for y in labels])
    flat = [f for r in rows for f in r]
    counts = np.array([len(f) for f in flat])
    starts, owner = np.concatenate(([0], np.cumsum(counts)[:-1])), np.repeat(np.arange(len(flat)), counts)
    ids = np.fromiter((i for f in flat for i in f), np.int64, len(owner))
    used, place = np.unique(ids, return_inverse=True)
    by_place = np.argsort(place, kind="stable")
    own_of, firsts = owner[by_place], np.searchsorted(place[by_place], np.arange(len(used)))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sizes_of = [len(used) * n_labels, n_labels * n_labels, n_labels]
    x = np.zeros(sum(sizes_of), np.float32)
    m, v = np.zeros_like(x), np.zeros_like(x)
    pair_gold = np.zeros((n_labels, n_labels))
    np.add.at(pair_gold, (gold[:-1], gold[1:]), 1)
    for e in begins[1:]:
        pair_gold[gold[e - 1], gold[e]] -= 1
    onehot = np.eye(n_labels, dtype=np.float32)[gold]
    first_gold = onehot[begins].sum(0)
    for step in range(1, steps + 1):
        u, moves, first = (p.reshape(s) for p, s in zip(np.split(x, np.cumsum(sizes_of)[:-1]), ((len(used), n_labels), (n_labels, n_labels), (n_labels,)), strict=True))
        token = np.add.reduceat(u[place], starts).astype(np.float64)
        s = np.ones((n, most, n_labels))
        s[inside] = np.exp(token - token.max(1, keepdims=True))
        through = np.exp(moves.astype(np.float64))
        ahead, scale = np.zeros((most, n, n_labels)), np.ones((most, n, 1))
        ahead[0] = np.exp(first.astype(np.float64) - first.max()) * s[:, 0]
        ahead[0] /= ahead[0].sum(1, keepdims=True)
        for t in range(1, most):
            k = left[t]
            new = ahead[t - 1, :k] @ through * s[:k, t]
            scale[t, :k] = new.sum(1, keepdims=True)
            ahead[t, :k] = new / scale[t, :k]
        behind, pair = np.ones((most, n, n_labels)), np.zeros((n_labels, n_labels))
        for t in range(most - 1, 0, -1):
            k = left[t]
            part = s[:k, t] * behind[t, :k] / scale[t, :k]
            behind[t - 1, :k] = part @ through.T
            pair += through * (ahead[t - 1, :k].T @ part)
        single = (ahead * behind).transpose(1, 0, 2)
        single = single[inside] / single[inside].sum(1, keepdims=True)
        gap = (single - onehot).astype(np.float32)
        grad_u = np.add.reduceat(gap[own_of], firsts)
        grad = np.concatenate([grad_u.ravel(), (pair - pair_gold).ravel(), single[begins].sum(0) - first_gold]).astype(np.float32) / n + 1e-3 * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    u, moves, first = np.split(x, np.cumsum(sizes_of)[:-1])
    unary = np.zeros((FEATURES, n_labels))
    unary[used] = u.reshape(len(used), n_labels)
    return Chain(unary, moves.reshape(n_labels, n_labels).astype(np.float64), first.astype(np.float64))


#: The small labelled table's templates: # is a digit, @name and @host an invented word; marked parts carry the kind's label.
TEMPLATES = (
    "call {phone|(###) ###-####} today", "phone: {phone|###-###-####}", "tel. {phone|### ### ####} or mail", "tel {phone|00## ## #######}", "reach me on {phone|(0##) #### ####}.", "fax {phone|1-###-###-####}",
    "mobile {phone|0### ### ####}", "my number is {phone|###.###.####}", "call {phone|0##/#######} now", "phone {phone|##########}", "contact {phone|(###) ### ####}", "{phone|(###) ###-####} is my cell",
    "write to {email|@name at @host dot com}", "mail {email|@name (at) @host (dot) org}", "email: {email|@name [at] @host [dot] net} please", "{email|@name.@name at @host dot @host dot com}", "send it to {email|@name AT @host DOT com}", "contact {email|@name [at] @host dot de} for more",
    "card {card|####/####/####/####} expires", "card number {card|#### . #### . #### . ####}", "visa {card|####.####.####.####} paid", "pay with {card|####/######/#####}",
    "on 20##-##-## we met", "version #.##.#", "the year 19## and 20##", "from 1### to 1### there were", "order ######## was sent", "page ### of ####", "price $ #,###.## only", "id ############", "isbn 978-#-##-######-#", "at ##:##:## on ##/##/20##",
    "pi is 3.##########", "serial ####-##-####-##", "total 1 ### ### units", "serie ## ## ## ## ##", "sum ### + ### + ###", "look at the dot on it", "meet at noon dot", "value #.######## of", "row ## ### ## # ###", "##.##.20## - ##.##.20##", "@name at @host was here", "code ###############", "build 20######.####",
    "###########.####", "lat ##.###### lon ##.######", "ref. ##/###/####/##", "key ######## ######## ########", "copyright 20## - 20##", "(20##) ### - ###", "tonnes 12 ### ### ###", "he sat at home dot",
    "write to {email|@name.@name [at] @host.com}", "mail {email|@name (at) @host.com} please", "contact {email|@name @ @host dot com}", "email {email|@name@@host dot org} for more", "send it to {email|@name @ @host.de} today", "{email|@name [at] @host.@host.net} or call", "reach {email|@name.@name(at)@host.org}", "mail {email|@name (at) @host . com}",
    "mail {email|@name at @host dot com} please", "{email|@name [at] @host [dot] com}", "address: {email|@name_@name(at)@host(dot)de}", "write to {email|@name.@name at @host dot @host dot org}", "ask {email|@name.@name AT @host DOT co DOT uk} today", "or {email|@name-@name (at) @host dot net}.", "my mail is {email|@name## at @host dot edu} and", "call or mail {email|@name_@name [at] @host.@host [dot] org} now",
    "visit us at @host.com for more", "look at @host.org and @host.com", "we met at @host.@name then", "it is sold @ #.## each", "see you at home.then we go", "he was at work. a dot is there", "open at ##.## daily", "follow @name at @host.com now", "he (at @host.com) said",
    "tel {phone|###\u00a0###\u00a0####}", "call {phone|###\u2013###\u2013####} today", "phone {phone|###\u00b7###\u00b7####} now", "fax {phone|(###)\u00a0###\u2011####}", "mobile {phone|### - ### - ####}", "call {phone|### | ### | ####}", "phone {phone|###_###_####}", "card {card|####\u00b7####\u00b7####\u00b7####} expires", "visa {card|####_####_####_####} paid",
    'token = "{secret|@hex}"', "token: {secret|@hex} end", "api_key={secret|@code}", 'secret = "{secret|@code}" #', "Authorization: Bearer {secret|@code}", "the key is {secret|@hex} keep it", 'password: "{secret|@code}"', "access_token={secret|@code}&x", "secret-key '{secret|@hex}'",
    'token = "@name@name@name@name"', "key = @name@name_@name", "the token is @name@name@name@name now", "key: ####-##-## ##:##", "password: @name@name@name@name@name", "token = ##########", "the key to @name@name@name@name", "keys: @name.@name.@name", "token @name-@name-@name-@name",
    "values ##, ##, ##, ##, ##, ##", "scores #, #, #, #, #, #, #, #, #, #", "sum ###,###,###,###", "from ##:##:##, ##:##:## on", "ratio ##:##:##:##:##", "$#,###; $##,###; $###", "points (#,#), (#,#), (#,#), (#,#)", "##% ##% ##% ##% ##%", "years 19##\u201320##, 20##\u201320##",
)


#: Forms of one kind are all combinations of such parts, each in one of the sentences; ~ is the form's separator.
GROUPS = ("###~###~####", "(###)~###~####", "0##~###~####", "0###~######", "0##~###~##~##", "0#~##~##~##~##", "####~###~###", "00##~##~###~####", "1~###~###~####", "0##~########")
CARDS = ("####~####~####~####", "####~######~#####", "####~#### ####~####")
SEPARATORS = (" ", "-", ".", "/", " - ", " / ", " . ", "|", " | ", "_", ", ", "\u00a0", "\u2013", "\u00b7", " \u2013 ")
QUOTES = "\"'"
NAMES = ("@name", "@name.@name", "@name_@name", "@name-@name", "@name##", "@name dot @name", "@name underscore @name")
ATS = (" at ", " [at] ", " (at) ", "(at)", "[at]", " AT ", " @ ", " {at} ", " <at> ", "@")
DOTS = (" dot ", " [dot] ", " (dot) ", "(dot)", "[dot]", " DOT ", ".", " . ", " {dot} ")
LEADS = ("token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "access_token", "secret-key", "client_secret", "tokens", "aws_secret_key", "credential")
SIGNS = ("=", ": ", " = ", " is ", ":", ' "', "='", '="', ': "', " '")
CODES = ("@hex", "@code", "@upper", "@mixed")
HOSTS = ("@host~com", "@host~@host~org", "@host~co~uk", "@host~de")
SENTENCES = {
    "phone": ("{}", "call {} today", "tel {} or", "tel. {}", "phone: {} please", "reach me on {} now", "fax {}", "my mobile is {}.", "ring {} at night", "telefon {} bis", "our number {} is", "dial {}", "text {} first"),
    "card": ("card {} expires", "pay with {} now", "visa {} paid", "my credit card is {}.", "card number: {}", "karte {} bis", "charge {} today", "amex {}"),
    "secret": ("{}", "{} end", "use {} here", "# {}", "set {} or"),
    "email": ("{}", "write to {} please", "mail {} today", "email: {}", "contact {} for more", "or {}.", "{} is my address", "send it to {} now", "ask {}"),
    "": ("order {} was sent", "invoice {} is due", "serial {} here", "isbn {}", "build {} of", "total {} units", "id {}", "ref. {} of", "ticket {} closed", "row {} of", "page {}"),
}


@functools.cache
def forms() -> tuple[tuple[str, str], ...]:
    """All forms as (kind, form); an address that the base pattern takes whole is none."""
    phones = [g.replace("~", s) for g in GROUPS for s in SEPARATORS if s != ", "]
    cards = [g.replace("~", s) for g in CARDS for s in SEPARATORS if s not in " -"]
    mails = [n + a + h.replace("~", d) for n in NAMES for a in ATS for d in DOTS for h in HOSTS if not (a == "@" and d == ".")]
    others = [g.replace("~", s) for g in ("## ### ## # ###", "#~##~###~####", "###~###~###~###", "########", "############", "##~##~##~##~##~##", "20##~##~##~####") for s in SEPARATORS]
    secrets = [f"{lead}{sign}{{secret|{code}}}{sign[-1] * (sign[-1] in QUOTES)}" for lead in (*LEADS, "Authorization: Bearer") for sign in (SIGNS if lead in LEADS else (" ",)) for code in CODES]
    return tuple((k, f) for k, of in (("phone", phones), ("card", cards), ("email", mails), ("secret", secrets), ("", others)) for f in of)


def composed(number: int, seed: int, of: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """So many templates of each kind, drawn from forms and sentences."""
    r = random.Random(seed)
    kinds: dict[str, list[str]] = {}
    for kind, form in of:
        kinds.setdefault(kind, []).append(form)
    # braces of a form are no marks; a secret's form is marked already
    marked = lambda kind, form: form if kind in ("", "secret") else "{" + kind + "|" + form.replace("{", "\x01").replace("}", "\x02") + "}"
    return tuple(r.choice(SENTENCES[kind]).replace("{}", marked(kind, r.choice(held))) for kind, held in kinds.items() for _ in range(number))


ALPHABETS = {"@hex": "0123456789abcdef", "@code": "0123456789ABCDEFGHJKLMNabcdefghijkmnopqrstuvwxyz", "@upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@mixed": "0123456789ABCDEFGHJKLMNabcdefghijkmnopqrstuvwxyz+/_-"}
#: Composed templates of each kind in the labelled table.
COMPOSED = 160


def labelled_table(copies: int = 3, seed: int = 11, templates: tuple[str, ...] = TEMPLATES, of: tuple[tuple[str, str], ...] | None = None) -> list[tuple[str, list[Span]]]:
    """The labelled examples: each template filled `copies` times, and COMPOSED ones of each kind's forms, with the spans of their
    marked parts; cards pass the check."""
    r, out = random.Random(seed), []
    drawn = composed(COMPOSED, seed, forms() if of is None else of)
    name = lambda _: "".join(r.choice(("an", "er", "th", "on", "mi", "lo", "ka", "su", "re", "ti")) for _ in range(r.randint(1, 4)))
    for template in templates * copies + drawn:
        text, spans = "", []
        for part in re.split(r"(\{[^}]*\})", r.choice((f"{name(0)} ", f"{name(0)} {name(0)} ", "")) + template + r.choice((f" {name(0)} {name(0)}", f" {name(0)}", ""))):
            kind, _, body = part[1:-1].partition("|") if part[:1] == "{" else ("", "", part)
            body = re.sub("@name|@host", name, re.sub("#", lambda _: str(r.randint(0, 9)), body))
            body = re.sub("@hex|@code|@upper|@mixed", lambda m: "".join(r.choice(ALPHABETS[m[0]]) for _ in range(r.choice((20, 24, 32, 40)))), body)
            body = body.replace("\x01", "{").replace("\x02", "}")
            if kind == "card":
                body = next(b for d in "0123456789" if luhn(re.sub(r"\D", "", b := body[:-1] + d)))
            if kind:
                spans.append((len(text), len(text) + len(body), FIELD_KINDS.index(kind)))
            text += body
        out.append((text, spans))
    return out


def plain(text: str) -> str:
    """The text as the field reads it, of the same length."""
    return text if text.isascii() or not UNPLAIN.search(text) else text.translate(PLAIN)


def windows(text: str) -> list[tuple[int, int]]:
    """The stretches whose tokens can carry a label."""
    found = [(m.start(), m.end()) for m in NUMBER.finditer(text)]
    for m in AT.finditer(text):
        a, b = m.span()
        if m[0] == "@" and a and text[a - 1] in LOCAL and DOMAIN.match(text, b) and not DOT.search(text, DOMAIN.match(text, b).end(), b + LONGEST):
            continue  # a base address
        begin, end = max(0, a - BEFORE), min(len(text), b + AFTER)
        while begin and a - begin < LONGEST and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and end - b < LONGEST and not text[end].isspace():
            end += 1
        if DOT.search(text, b, end):
            found.append((begin, end))
    for m in KEYED.finditer(text):
        end = SECRET.match(text, m.end())
        found.append((m.start(), min(len(text), end.end() + 2)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tokens_around(text: str, a: int, b: int) -> tuple[list[re.Match], int, int]:
    """The window's tokens with CONTEXT tokens on either side; which of them are the window's."""
    inner = list(TOKEN.finditer(text, a, b))
    before, reach = [], 24
    while True:
        begin = max(0, a - reach)
        before = list(TOKEN.finditer(text, begin, a))
        if len(before) > CONTEXT or not begin or reach > 400:
            break
        reach *= 2
    after = []
    for m in TOKEN.finditer(text, b):
        after.append(m)
        if len(after) == CONTEXT:
            break
    before = before[-CONTEXT:]
    return [*before, *inner, *after], len(before), len(before) + len(inner)


def rows_of(text: str, a: int, b: int) -> tuple[list[re.Match], list[list[int]]]:
    around, i, j = tokens_around(text, a, b)
    words = [m[0] for m in around]
    gaps = [k == 0 or around[k - 1].end() < m.start() for k, m in enumerate(around)]
    runs, cues, tags, at = runs_of(text, a, b), None, [], 0
    for m in around[i:j]:
        while at < len(runs) and runs[at][1] <= m.start():
            at += 1
        if at < len(runs) and runs[at][0] <= m.start():
            cues = cues_of(text, a, b) if cues is None else cues
            tags.append([*runs[at][2], *cues, *(f"{c}{runs[at][2][0]}" for c in cues)])
        else:
            tags.append(["n0"])
    return around[i:j], [features(words, gaps, k, tags[k - i]) for k in range(i, j)]


@functools.cache
def default_chain() -> Chain:
    return fit(labelled_table())


def fit(table: list[tuple[str, list[Span]]]) -> Chain:
    """Train on labelled texts; every window of every text is a sequence."""
    rows, labels = [], []
    for text, spans in table:
        text = plain(text)
        for a, b in windows(text):
            inner, found = rows_of(text, a, b)
            own = []
            for m in inner:
                span = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1]), None)
                own.append(0 if span is None else LABELS.index(f"{'B' if m.start() == span[0] else 'I'}-{FIELD_KINDS[span[2]]}"))
            if found:
                rows.append(found)
                labels.append(own)
    return train(rows, labels)


#: Digits that an added span must hold.
DIGITS = {0: (0, 99), 2: (14, 19), 3: (10, 13), 4: (2, 200)}


def added_spans(texts: list[str], bases: list[list[Span]], chain: Chain) -> list[list[Span]]:
    """What the field finds beside the base spans in a batch of texts."""
    of, inner, rows = [], [], []
    texts = [plain(t) for t in texts]
    for k, text in enumerate(texts):
        for a, b in windows(text):
            if any(s < b and a < e for s, e, _ in bases[k]) and not any(a < s - 10 or b > e + 10 for s, e, _ in bases[k] if s < b and a < e):
                continue  # nothing but a base span
            matches, found = rows_of(text, a, b)
            if found:
                of.append(k)
                inner.append(matches)
                rows.append(found)
    out: list[list[Span]] = [[] for _ in texts]
    if not rows:
        return out
    for k, matches, path in zip(of, inner, decoded(rows, chain), strict=True):
        at = 0
        while at < len(path):
            label = LABELS[path[at]]
            end = at + 1
            if label != "O":
                while end < len(path) and LABELS[path[end]] == f"I-{label[2:]}":
                    end += 1
                a, b, kind = matches[at].start(), matches[end - 1].end(), FIELD_KINDS.index(label[2:])
                if kind == 4:
                    while a and texts[k][a - 1].isalnum():
                        a -= 1
                    while a < b and not SECRET.match(texts[k], a):
                        a += 1
                    run = SECRET.match(texts[k], a)
                    b = a + len(run[0].rstrip(".")) if run else b
                if kind == 0:
                    for m in ADDRESS.finditer(texts[k], max(0, a - LONGEST), b + LONGEST):
                        if m.start() < b and a < m.end():
                            a, b = min(a, m.start()), max(b, m.end())
                digits = re.sub(r"\D", "", texts[k][a:b])
                least, most = DIGITS[kind]
                valid = least <= len(digits) <= most and (kind != 4 or b - a >= 16 and any(x.isalpha() for x in texts[k][a:b])) and (kind != 2 or luhn(digits)) and (kind != 0 or (m := AT.search(texts[k], a, b)) and DOT.search(texts[k], m.end(), b))
                if label[0] == "B" and valid and not any(s < b and a < e for s, e, _ in (*bases[k], *out[k][-1:])):
                    out[k].append((a, b, kind))
            at = end
    return out


def _found(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bases = [base_spans(t) for t in texts]
        more = added_spans(texts, bases, chain.value)
        both = [sorted(a + [s for s in b if s[2] < len(KINDS)], key=lambda s: (s[0], s[2], s[1])) for a, b in zip(bases, more, strict=True)]
        secrets = [",".join(f"secret:{a}:{b}" for a, b, k in m if k == len(KINDS)) for m in more]
        counts = [pa.array([sum(s[2] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
        columns = [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases]), pa.array(map(written, both), pa.string()), pa.array(map(len, more), pa.int64()), pa.array(secrets, pa.string())]
        yield pa.record_batch(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets"])


def find(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id, the base matches' counts by kind and digest, all spans of these kinds as kind:start:end, how many spans the field
    added, secrets among them, and the secrets' spans.

    Positions are code points, ends exclusive. A null or empty text has no spans; a null doc_id is kept; repeated rows give a row
    each; an empty table none. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain or default_chain())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _found(it, shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string")


def _redacted(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column("text").to_pylist()
        texts = [t or "" for t in given]
        bases = [base_spans(t) for t in texts]
        out = []
        for text, whole, spans in zip(given, texts, map(list.__add__, bases, added_spans(texts, bases, chain.value)), strict=True):
            parts, at = [], 0
            for a, b, k in sorted(spans):
                if b > at:
                    parts += [whole[at:a], f"[{FIELD_KINDS[k].upper()}]"] if a >= at else []
                    at = b
            out.append("".join(parts) + whole[at:] if spans else text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def redact(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """The documents with every span, secrets too, replaced by its kind in brackets; overlapping spans go as one, under the
    first's kind.

    A null or empty text stays as it is; null ids, repeated rows and further columns of any names are kept; an empty table gives
    none. Very long texts are read whole, in time that grows with their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain or default_chain())
    return docs.mapInArrow(lambda it: _redacted(it, shared), docs.schema)
