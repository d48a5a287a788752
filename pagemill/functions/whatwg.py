"""URLs the way browsers read them, in plain Python: one parser for all UDFs.

Covers special schemes: case, default ports, spaces and other characters that must
be encoded, IDN hosts, numeric IPv4 forms, IPv6, dot segments and references.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote, unquote, urljoin

_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#/<>?@\[\\\]^|%\x7f]")


class Url(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: str
    query: str
    fragment: str

    @property
    def netloc(self) -> str:
        return self.host if self.port is None else f"{self.host}:{self.port}"

    def text(self, query: bool = True, fragment: bool = False) -> str:
        return f"{self.scheme}://{self.netloc}{self.path}" + (f"?{self.query}" if query and self.query else "") + (f"#{self.fragment}" if fragment and self.fragment else "")


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        if len(part) > 1 and part[0] == "0":
            return int(part, 8)
        return int(part) if part.isascii() and part.isdigit() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; '' if it is out of range."""
    parts = host.rstrip(".").split(".")
    if not parts[-1] or not (parts[-1].isdigit() or re.fullmatch(r"0[xX][0-9A-Fa-f]*", parts[-1])):
        return None
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or any(n is None for n in numbers):
        return ""
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return ""
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(text: str) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    short = [f"{value >> shift & 0xFFFF:x}" for shift in range(112, -1, -16)]
    best, at = 1, -1
    i = 0
    while i < 8:
        j = i
        while j < 8 and short[j] == "0":
            j += 1
        if j - i > best:
            best, at = j - i, i
        i = max(j, i + 1)
    if at < 0:
        return ":".join(short)
    return f"{':'.join(short[:at])}::{':'.join(short[at + best:])}"


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        inner = _ipv6(raw[1:-1]) if raw.endswith("]") else None
        return None if inner is None else f"[{inner}]"
    host = unquote(raw)
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    host = host.lower()
    if not host or _BAD_HOST.search(host):
        return None
    four = _ipv4(host)
    return host if four is None else four or None


def _path(path: str) -> str:
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:]
    for i, p in enumerate(parts):
        dots = p.lower().replace("%2e", ".")
        if dots == "..":
            if out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif dots == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(quote(p, safe="%!$&'()*+,;=:@-._~[]|^\\"))
    return "/" + "/".join(out)


@lru_cache(65536)
def parse(text: str, base: str | None = None) -> Url | None:
    """The URL, or None where a browser's parser would fail or the scheme has no host."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(text)
    if base is not None and (not m or (m[1].lower() in _PORTS and not text[m.end() :].startswith(("/", "\\")))):
        rest = text[m.end() :] if m else text
        absolute = base if not rest else urljoin(base, rest.replace("\\", "/") if not rest.startswith(("?", "#")) else rest)
        return parse(absolute)
    if not m or m[1].lower() not in _PORTS:
        return None
    scheme, rest = m[1].lower(), text[m.end() :]
    rest = rest.lstrip("/\\")
    end = next((i for i, c in enumerate(rest) if c in "/\\?#"), len(rest))
    authority, tail = rest[:end].rpartition("@")[2], rest[end:]
    raw, port = authority, None
    if (p := re.search(r":(\d*)$", authority)) and not authority.endswith("]"):
        raw = authority[: p.start()]
        if p[1]:
            port = int(p[1])
            if port > 65535:
                return None
    host = _host(raw)
    if host is None:
        return None
    tail, _, fragment = tail.partition("#")
    path, _, query = tail.partition("?")
    return Url(scheme, host, None if port == _PORTS[scheme] else port, _path(path or "/"), quote(query, safe="%!$&()*+,;=:@-._~/?[]|^\\`{}"), fragment)


def normalize(value: str | None, base: str | None = None) -> str | None:
    """Resolved against a base, http or https only, without its fragment."""
    url = parse(value, base) if value is not None else None
    return url.text() if url and url.scheme in ("http", "https") else None
