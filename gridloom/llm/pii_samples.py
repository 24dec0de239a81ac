"""Generated candidates with labels, from which the trees for personal data learn.

Both labels come in the same shapes: what tells them apart is their make-up, a check sum or the words before them.
"""

from __future__ import annotations

import base64
import random

_HEX = "0123456789abcdef"
_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_ALNUM = _UPPER + _LOWER + _DIGITS
_BASE64 = (_ALNUM + "+/", _ALNUM + "-_")
_WORDS = (
    "the of and report version see chapter in from total width model released on for with was that it has been de la el der die und "
    "que los le les une est con por para ein nicht von ist dans pour sur all new first after between some more"
).split()
_SYLLABLES = "ba con der est fi gra ho in jun kel lor men nat ou pre qui ra sta ti un ver wo xi ya zen the and ing ion er re".split()
_NAMED = ["token", "api_key", "secret", "key", "auth", "Bearer", "access_key", "client_secret", "credentials", "private_key", "signature", "apikey"]
_SIGNS = [" = \"", "=", ": ", "='", ":", " "]
_HASHED = ["commit ", "sha1: ", "sha256:", "SHA-256 ", "md5=", "checksum ", "digest: ", "etag ", "hash ", "revision ", "blob ", "tree ", "build ", "uuid: "]
_NUMBERED = ["order ", "invoice ", "page ", "part ", "serial ", "item ", "isbn ", "ref ", "number ", "ticket ", "order no. ", "version "]
_PASSWORDS = ["password", "passwd", "pwd", "Passwort", "passphrase", "PASSWORD", "db_password", "pass", "contraseña", "mot de passe", "user_pass", "passcode"]


def _some(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choices(chars, k=n))


def _words(rng: random.Random) -> str:
    """Some words, and a gap or mark after them if there are any."""
    said = " ".join(rng.choices(_WORDS, k=rng.randint(0, 7)))
    return said and said + rng.choice([" ", " ", " ", ", ", ". ", "\n", " (", ": "])


def _word(rng: random.Random, low: int = 4, high: int = 12) -> str:
    word, n = "", rng.randint(low, high)
    while len(word) < n:
        word += rng.choice(_SYLLABLES)
    return word


def _joined(rng: random.Random, gaps: str, low: int, high: int) -> str:
    """Words, years and small numbers joined as in slugs, paths and names."""
    case = rng.choice([str.lower, str.lower, str.upper, str.title])
    parts = [case(_word(rng, 2, 9)) if rng.random() < 0.85 else str(rng.randint(1, 2030)) for _ in range(rng.randint(low, high))]
    return rng.choice(gaps).join(parts)


def _random_run(rng: random.Random) -> str:
    """What a generator of keys gives, in letters and digits."""
    kind = rng.randint(0, 5)
    if kind <= 1:
        return _some(rng, rng.choice([_HEX, _HEX, "0123456789ABCDEF"]), rng.choice([20, 24, 32, 32, 40, 40, 48, 64, 96, 128]))
    if kind <= 3:
        return _some(rng, _ALNUM, rng.choice([20, 22, 24, 28, 32, 36, 40, 43, 48, 64]))
    if kind == 4:
        return rng.choice(["AKIA", "ASIA"]) + _some(rng, _UPPER + "234567", 16)
    return _some(rng, _UPPER + _LOWER, rng.choice([20, 24, 32, 40, 48, 64]))


def _secret_before(rng: random.Random) -> str:
    """Bare, named, or in an address."""
    kind = rng.randint(0, 5)
    if kind <= 1:
        return _words(rng)
    if kind == 2:
        return _words(rng) + f"https://{_word(rng)}.{rng.choice(['com', 'org', 'io'])}/{_word(rng)}{rng.choice(['?key=', '?token=', '?id=', '/', '?a=1&sig='])}"
    return _words(rng) + rng.choice(_NAMED) + rng.choice(_SIGNS)


def _long_secret(rng: random.Random) -> str:
    """A key, signature or token segment on one line: 100 to 6400 characters."""
    body = _some(rng, rng.choice([_HEX, *_BASE64]), int(100 * 64 ** rng.random()))
    return rng.choice(["", "eyJ", "MII", "AAAA"]) + body + "=" * rng.randint(0, 2)


def _secret(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 3)
    if kind == 0:
        return _long_secret(rng), _secret_before(rng)
    if kind == 1:
        start = rng.choice(["sk_live_", "sk_test_", "rk_live_", "ghp_", "gho_", "glpat-", "xoxb-", "npm_", "sk-", "sk-proj-", "pk_live_"])
        return start + _some(rng, _ALNUM, rng.choice([20, 24, 32, 36, 40])), _secret_before(rng)
    if kind == 2:
        return _some(rng, rng.choice(_BASE64), rng.choice([24, 32, 40, 43, 44, 64, 88])) + "=" * rng.randint(0, 2), _secret_before(rng)
    return _random_run(rng), _secret_before(rng)


def _not_run(rng: random.Random) -> tuple[str, str]:
    """Runs of letters and digits that are no keys, whatever stands before them; and those that are named as hashes."""
    kind = rng.randint(0, 6)
    before = _words(rng) + rng.choice(["", "", "", rng.choice(_NAMED) + rng.choice(_SIGNS), rng.choice(_NUMBERED)])
    if kind == 0:
        return _some(rng, _DIGITS, rng.choice([16, 16, 17, 18, 20, 24, rng.randint(16, 400)])), before
    if kind == 1:
        word = _word(rng, 16, 40)
        return rng.choice([word, word, word.title(), word.upper()]), before
    if kind == 2:
        return "".join(_word(rng, 2, 8).title() for _ in range(rng.randint(4, 8))), before  # names in capitals and small letters
    if kind == 3:
        return _word(rng, 14, 24) + str(rng.randint(1, 2030)), before
    if kind == 4:
        return rng.choice(_LOWER + "xX0") * rng.randint(16, 80), before
    if kind == 5:
        return _some(rng, _HEX, rng.choice([32, 40, 40, 64, 64, 128])), _words(rng) + rng.choice(_HASHED)
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(6, 12))) + rng.choice(["", "s", "en"]), before


def _not_secret(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 6)
    before = _words(rng) + rng.choice(["", "", "/", "=", ": ", "key ", "token="])
    if kind == 0:
        return _joined(rng, "-_/+", 3, 7), before
    if kind == 1:
        return _joined(rng, "-_/", 8, 400), before
    if kind == 2:
        return "/".join(_word(rng, 3, 9) for _ in range(4)) + str(rng.randint(1, 99)), before + "/"
    if kind == 3:
        day = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return rng.choice([day + f"-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", day + "/" + day, day + "_" + _word(rng)]), before
    if kind == 4:
        return rng.choice("-_+/x0") * rng.randint(16, 400) + rng.choice(["", str(rng.randint(1, 2030))]), before
    if kind == 5:
        return "-".join(_some(rng, _HEX, n) for n in (8, 4, 4, 4, 12)), _words(rng) + rng.choice(["", "uuid: ", "id ", "guid="])
    return _not_run(rng)


def _key(rng: random.Random) -> tuple[str, str]:
    return _random_run(rng), _secret_before(rng)


def _password(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 3)
    named = rng.choice(_PASSWORDS)
    if kind == 0:
        value = _word(rng, 6, 16) + rng.choice(["", _word(rng, 4, 8)])
    elif kind == 1:
        value = _word(rng, 4, 9).title() + _some(rng, _DIGITS, rng.randint(1, 4)) + rng.choice(["", "!", "#", "$"])
    elif kind == 2:
        value = _some(rng, _ALNUM + "!@#$%^&*-_", rng.randint(8, 24))
    else:
        value, named = _some(rng, _ALNUM, rng.randint(10, 40)), rng.choice([*_NAMED[:5], *_NAMED[6:]])
    return value, _words(rng) + named + rng.choice([": ", "=", " = ", " = \"", "='", ":"])


def _not_password(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 3)
    signs = [": ", "=", " = ", " = \"", ":"]
    if kind == 0:
        value = rng.choice(["none", "null", "true", "false", "None", "required", "optional", "changeme", "empty", "missing", "hidden", "redacted", "example", "unknown", "********", "xxxxxxxx", "[SECRET]", "{password}", "<hidden>", "(see"])
        return value, _words(rng) + rng.choice([*_PASSWORDS, *_NAMED]) + rng.choice(signs)
    if kind == 1:
        return _word(rng, 4, 10), _words(rng) + rng.choice(["token", "key", "secret", "auth", "author", "keyword", "keyboard", "authors", "tokens", "passage", "passenger", "passing", "keynote", "secretary"]) + rng.choice(signs)
    if kind == 2:
        return _word(rng, 4, 10).title() + rng.choice(["", ".", "-" + _word(rng)]), _words(rng) + rng.choice(["author", "keynote", "passenger", "secretary", "authority"]) + rng.choice(signs)
    return str(rng.randint(1000, 99999)), _words(rng) + rng.choice(["tokens", "passengers", "keys", "max_tokens", "keycode", "passes"]) + rng.choice(signs)


def _pem(rng: random.Random, names: list[str]) -> tuple[str, str]:
    name = rng.choice(names)
    body = base64.b64encode(rng.randbytes(rng.randint(32, 1600))).decode()
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) if rng.random() < 0.7 else body
    return f"-----BEGIN {name}-----\n{lines}\n-----END {name}-----", _words(rng) + rng.choice(["", "key: ", "pem = \""])


def _private(rng: random.Random) -> tuple[str, str]:
    return _pem(rng, ["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "DSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])


def _public(rng: random.Random) -> tuple[str, str]:
    return _pem(rng, ["PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE", "CERTIFICATE REQUEST", "PGP SIGNATURE", "X509 CRL", "PGP PUBLIC KEY BLOCK"])


def _jwt(rng: random.Random) -> tuple[str, str]:
    part = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    return "eyJ" + part(rng.randint(15, 60)) + ".eyJ" + part(rng.randint(20, 300)) + "." + part(rng.choice([32, 64, 256])), _secret_before(rng)


def _not_jwt(rng: random.Random) -> tuple[str, str]:
    return "eyJ" + _word(rng, 5, 20) + "." + rng.choice([_word(rng, 2, 12), "html", "com"]) + rng.choice(["", "." + _word(rng)]), _words(rng)


def _social(rng: random.Random, gap: str) -> str:
    return f"{rng.choice([*range(1, 666), *range(667, 900)]):03}{gap}{rng.randint(1, 99):02}{gap}{rng.randint(1, 9999):04}"


def _ssn(rng: random.Random) -> tuple[str, str]:
    named = rng.choice(["SSN ", "ssn: ", "social security number ", "Social Security: ", "SSN#", "soc. security no. ", "SSN no. ", "social number: "])
    return (_social(rng, "-"), _words(rng) + rng.choice([named, "", "", f"{rng.randint(1900, 2030)}, "])) if rng.random() < 0.7 else (_social(rng, " "), _words(rng) + named)


def _not_ssn(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 3)
    if kind == 0:
        return _social(rng, " "), _words(rng) + _some(rng, _DIGITS, rng.randint(1, 4)) + " "
    if kind == 1:
        return rng.choice(["000", "666", f"{rng.randint(900, 999)}"]) + f"-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04}", _words(rng)
    if kind == 2:
        return f"{rng.randint(1, 899):03}-00-{rng.randint(0, 9999):04}", _words(rng) + rng.choice(["", "no. "])
    return _social(rng, rng.choice("- ")), _words(rng) + rng.choice(_NUMBERED)


def _account(rng: random.Random, valid: bool) -> str:
    country = _some(rng, _UPPER, 2)
    body = rng.choice(["", _some(rng, _UPPER, 4)]) + _some(rng, _DIGITS, rng.choice([12, 14, 16, 18, 20]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    check = check if valid else (check + rng.randint(1, 90)) % 97 + 2
    whole = f"{country}{check:02}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def _iban(rng: random.Random) -> tuple[str, str]:
    named = rng.choice(["IBAN ", "iban: ", "account ", "Bank account: ", "Konto ", "IBAN: ", "cuenta "])
    if rng.random() < 0.7:
        return _account(rng, True), _words(rng) + rng.choice([named, "", ""])
    return _account(rng, False), _words(rng) + named


def _not_iban(rng: random.Random) -> tuple[str, str]:
    if rng.random() < 0.5:
        return _account(rng, False), _words(rng) + rng.choice(["", "", *_NUMBERED])
    tail = "".join(" " * rng.randint(0, 1) + _some(rng, _UPPER, 1) for _ in range(rng.randint(11, 25)))
    return _some(rng, _UPPER, 2) + _some(rng, _DIGITS, 2) + tail, _words(rng)


def _called(rng: random.Random, sizes: tuple[int, int, int], bracketed: bool) -> str:
    first, *rest = (_some(rng, _DIGITS, n) for n in sizes)
    gap = rng.choice("-. ")
    return f"({first}) " + gap.join(rest) if bracketed else gap.join([first, *rest])


def _local(rng: random.Random) -> tuple[str, str]:
    named = rng.choice(["phone ", "tel: ", "call ", "fax: ", "Tel. ", "mobile: ", "cell ", "contact: ", "phone: "])
    if rng.random() < 0.75:
        return _called(rng, (3, 3, 4), rng.random() < 0.5), _words(rng) + rng.choice([named, named, ""])
    return _called(rng, (rng.randint(2, 4), rng.randint(3, 4), rng.randint(3, 4)), rng.random() < 0.3), _words(rng) + named


def _not_local(rng: random.Random) -> tuple[str, str]:
    kind = rng.randint(0, 2)
    sizes = rng.choice([(2, 3, 3), (2, 4, 4), (4, 4, 4), (4, 3, 3), (3, 4, 3), (2, 4, 3), (3, 3, 3)])
    if kind == 0:
        return _called(rng, sizes, False), _words(rng) + rng.choice(["", "", "12 ", "3, "])
    if kind == 1:
        return _called(rng, (3, 3, 4), False), _words(rng) + rng.choice(_NUMBERED)
    return _called(rng, (3, 3, 4), False), _words(rng) + _some(rng, _DIGITS, rng.randint(1, 4)) + rng.choice([" ", ", "])


#: Makers of both labels, in the order of the kinds.
_MAKERS = (
    (_secret, _not_secret),
    (_key, _not_run),
    (_password, _not_password),
    (_private, _public),
    (_jwt, _not_jwt),
    (_ssn, _not_ssn),
    (_iban, _not_iban),
    (_local, _not_local),
)


def generated(n: int, seed: int, first_kind: int = 4, context: int = 40) -> list[tuple[str, int, str, float]]:
    """n rows of (candidate, kind, text before it, label); half are personal data."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind, label = i // 2 % len(_MAKERS), i % 2
        found, before = _MAKERS[kind][0 if label else 1](rng)
        rows.append((found, first_kind + kind, before[-context:], float(label)))
    return rows
