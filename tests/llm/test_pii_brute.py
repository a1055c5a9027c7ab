"""Every pseudonym against a plain Feistel network over Python values."""

import datetime as dt
import hashlib
import random
import re

from aerolith.llm.common import read
from aerolith.llm.pii import GROUPED, PATTERNS, pseudonymise

KEY = "k"
DAY0 = dt.date(1800, 1, 1)


def keyed(key, kind, i, part):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{part}".encode()).hexdigest()[:15], 16)


def permute(value, low_size, high_size, key, kind):
    high, low = divmod(value, low_size)
    for i in range(10):
        if i % 2 == 0:
            low = (low + keyed(key, kind, i, high)) % low_size
        else:
            high = (high + keyed(key, kind, i, low)) % high_size
    return high * low_size + low


def lay_out(text, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def luhn(digits, doubled):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == doubled else 1)
        total += x - 9 * (x > 9)
    return total


def card(t):
    d = re.sub(r"\D", "", t)
    if luhn(d, 1) % 10:
        return None
    n = len(d) - 1
    new = str(permute(int(d[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), KEY, "card")).zfill(n)
    return lay_out(t, new + str((10 - luhn(new, 0) % 10) % 10))


def ssn(t):
    area, group, serial = t.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    new = permute((int(group) - 1) * 9999 + int(serial) - 1, 9999, 99, KEY + area, "ssn")
    return f"{area}-{new // 9999 + 1:02d}-{new % 9999 + 1:04d}"


def phone(t):
    d = re.sub(r"\D", "", t)
    if not re.fullmatch(GROUPED, t, re.A):
        n = len(d) - 3
        return lay_out(t, d[:3] + str(permute(int(d[3:]), 10 ** (n // 2), 10 ** (n - n // 2), KEY + d[:3], "phone")).zfill(n)) if 8 <= len(d) <= 15 else None
    return lay_out(t, d[:-7] + str(permute(int(d[-7:]), 1000, 10000, KEY + d[:-7], "phone")).zfill(7))


def ip(t):
    parts = list(map(int, t.split(".")))
    if max(parts) > 255:
        return None
    new = permute(int.from_bytes(bytes(parts), "big"), 65536, 65536, KEY, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def date(t):
    def valued(shape):
        try:
            day = dt.datetime.strptime(t, shape).date()
        except ValueError:
            return None
        return (DAY0 + dt.timedelta(permute((day - DAY0).days, 773, 189, KEY, "date"))).strftime(shape) if 1800 <= day.year < 2200 else None

    if "-" in t:
        return valued("%Y-%m-%d")
    if "." in t:
        return valued("%d.%m.%Y")
    if (new := valued("%m/%d/%Y")) is not None:
        return new
    d, m, y = map(int, t.split("/"))
    try:
        dt.date(y, m, d)
    except ValueError:
        return None
    if d <= 12 or not 1800 <= y < 2200:
        return None
    if d <= 28:
        new = permute(((y - 1800) * 12 + m - 1) * 16 + d - 13, 240, 320, KEY, "day-first")
        return f"{new % 16 + 13:02d}/{new // 16 % 12 + 1:02d}/{new // 192 + 1800}"
    is_leap = lambda x: x % 4 == 0 and (x % 100 != 0 or x % 400 == 0)
    years = [x for x in range(1800, 2200) if is_leap(x) == is_leap(y)]
    low = 1 if is_leap(y) else 3
    return f"{t[:6]}{years[permute(years.index(y), low, len(years) // low, KEY + t[:5], 'leap' if is_leap(y) else 'common')]}"


def email(t):
    local, rest = t.split("@", 1)
    half = (len(local) + 1) // 2
    parts = [local[:half], local[half:]]
    for i in range(4):
        own, other = i % 2, parts[1 - i % 2]
        out = ""
        for at, c in enumerate(parts[own]):
            move = keyed(KEY, "email", f"{i}|{at}", other)
            base = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else None
            out += c if base is None else chr(ord(base) + (ord(c) - ord(base) + move) % (10 if base == "0" else 26))
        parts[own] = out
    return f"{parts[0]}{parts[1]}@{rest}"


MASKS = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
ANY = re.compile("|".join(f"(?:{p})" for p in PATTERNS.values()), re.A)


def brute(text):
    counts = dict.fromkeys(MASKS, 0)

    def told(m):
        for kind, pattern in PATTERNS.items():
            if re.fullmatch(pattern, m[0], re.A):
                new = MASKS[kind](m[0])
                if new is not None:
                    counts[kind] += 1
                    return new
        return m[0]

    return (None, None) if text is None else (ANY.sub(told, text), counts)


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["pii"]) for r in pseudonymise(docs, KEY).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t
    return got


def test_all_documents_of_a_table(spark, sf_small):
    got = same(spark, [(r["doc_id"], r["text"]) for r in read(spark, sf_small, "documents").collect()])
    assert sum(sum(c.values()) for _, c in got.values() if c) > 10


def test_made_values_of_every_kind(spark):
    rng = random.Random(7)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    day = lambda: DAY0 + dt.timedelta(rng.randrange(146_097))
    makers = [
        lambda: (lambda d: d + str((10 - luhn(d, 0) % 10) % 10))(n(rng.randrange(12, 19))),
        lambda: n(16), lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"+1 {n(3)}-{n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"+{rng.randrange(1, 999)}{n(rng.randrange(5, 14))}", lambda: f"+{rng.randrange(1, 999)}{rng.choice(' .-')}{n(rng.randrange(1, 5))}{rng.choice(' .-')}{n(rng.randrange(3, 9))}", lambda: f"+49 ({n(2)}) {n(3)} {n(4)}-{n(2)}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: day().isoformat(), lambda: day().strftime("%d.%m.%Y"), lambda: day().strftime("%m/%d/%Y"), lambda: day().strftime("%d/%m/%Y"),
        lambda: f"{rng.randrange(40):02d}/{rng.randrange(14):02d}/{rng.randrange(1700, 2300)}",
        lambda: f"{rng.choice(['ann.Lee42', 'x', 'a_b-c'])}{n(2)}@{'.'.join('ab' for _ in range(rng.randrange(1, 12)))}.org", lambda: "ann@example.xn--p1ai",
    ]
    got = same(spark, [(i, "; ".join(rng.choice(makers)() for _ in range(6))) for i in range(500)])
    assert all(sum(c[k] for _, c in got.values()) > 20 for k in MASKS)


def test_day_first_dates_are_told_apart(spark):
    days = [d for d in (dt.date(1999, 1, 1) + dt.timedelta(i) for i in range(2_000)) if d.day > 12]
    got = same(spark, [(i, d.strftime("%d/%m/%Y")) for i, d in enumerate(days)])
    new = {t for t, _ in got.values()}
    assert len(new) == len(days) and all(int(t[:2]) > 12 for t in new)


def test_phone_numbers_from_abroad(spark):
    rows = [(1, "+15551234567"), (2, "call +49 30 1234567, or +44 20 7946 0958."), (3, "+1 (073) 555-8658"), (4, "+1234567 a+15551234567 +0123456789 +1234567890123456")]
    got = same(spark, rows)
    assert got[1][0][:4] == "+155" and got[1][0] != rows[0][1] and len(got[1][0]) == 12
    assert got[2][1]["phone"] == 2 and got[3][1]["phone"] == 1 and got[4] == (rows[3][1], dict.fromkeys(PATTERNS, 0))
