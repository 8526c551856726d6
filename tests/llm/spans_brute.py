"""Spans by Python's regular expressions, for comparison."""

import hashlib
import re

# re.I matches two non-ASCII letters for s and k; spell the cases out instead.
ASSIGN = re.compile("".join(
    f"[{c.upper()}{c}]" if c.isalpha() else c
    for c in "(password|passwd|secret|token|api_?key)") + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(kind, pattern, text, keep):
    return [(m.start(), kind, m.end()) for m in pattern.finditer(text) if keep(m)]


def secrets(text):
    text = text or ""
    return {
        "assign": find("assign", ASSIGN, text, lambda m: len(m[2]) >= 12),
        "access": find("access", re.compile("AKIA[A-Z0-9]+"), text, lambda m: len(m[0]) >= 18),
        "hex": find("hex", re.compile("[0-9a-f]+"), text, lambda m: len(m[0]) >= 16),
    }


def personal(text):
    text = text or ""
    return {
        "email": find("email", EMAIL, text, lambda m: True),
        "ip": find("ip", IP, text, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": find("card", CARD, text, lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        "phone": find("phone", PHONE, text, lambda m: 9 <= len(digits(m[0])) <= 15),
    }


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def digest(spans):
    return hashlib.sha256(shown(spans).encode()).hexdigest()
