"""Database URLs: parsing, redacted description, and choosing between direct and pooled ones.

No message ever holds the URL or a part of it that may be secret.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, unquote, unquote_to_bytes, urlencode, urlsplit, urlunsplit

from concordat.errors import Refusal, Refused, ToolkitError

SSL_MODES = ("disable", "require", "verify-ca", "verify-full")
#: Query keys that belong to drivers and say nothing about the database.
DRIVER_KEYS = ("connection_limit", "pool_timeout", "schema", "pgbouncer", "connect_timeout", "statement_cache_size", "application_name")


@dataclass(frozen=True)
class SqliteConfig:
    path: str
    in_memory: bool


@dataclass(frozen=True)
class PostgresConfig:
    host: str
    port: int
    database: str
    user: str | None
    password: str | None
    sslmode: str

    @property
    def jdbc(self) -> dict[str, str]:
        """Options for ``spark.read.jdbc``; the session is pinned so that values come in one form."""
        host = f"[{self.host}]" if ":" in self.host else self.host
        options = {
            "url": f"jdbc:postgresql://{host}:{self.port}/{quote(self.database, safe='')}?sslmode={self.sslmode}",
            "driver": "org.postgresql.Driver",
            "fetchsize": "5000",
            "sessionInitStatement": "set time zone 'UTC'; set bytea_output = 'hex'; set extra_float_digits = 3; set datestyle = 'ISO'",
        }
        return options | ({"user": self.user} if self.user else {}) | ({"password": self.password} if self.password else {})


def _bad(what: str) -> ToolkitError:
    return ToolkitError("INVALID_DATABASE_URL", f"Invalid DATABASE_URL: {what}")


def _decoded(part: str, what: str) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", part):
        raise _bad(f"{what} is not valid percent-encoding")
    try:
        return unquote_to_bytes(part).decode("utf-8")
    except UnicodeDecodeError:
        raise _bad(f"{what} is not valid percent-encoding") from None


def _sqlite(rest: str) -> SqliteConfig:
    if "?" in rest or "#" in rest:
        raise _bad("sqlite URLs take no query string or fragment")
    if rest.startswith("//"):
        if not rest.startswith("///"):
            raise _bad("sqlite URL has an authority; use file:///absolute/path or file:relative/path")
        rest = rest[2:]
    path = _decoded(rest, "sqlite path")
    if not path:
        raise _bad("sqlite path is empty")
    return SqliteConfig(path, path == ":memory:")


def _postgres(url: str) -> PostgresConfig:
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        raise _bad("postgres URL could not be parsed (percent-encode special characters in the password)") from None
    if parts.fragment:
        raise _bad("postgres URLs take no fragment")
    query: dict[str, str] = {}
    for key, value in parse_qsl(parts.query, keep_blank_values=True):
        if key not in ("sslmode", "user", "password"):
            raise _bad("unsupported query parameter (allowed: sslmode, user, password)")
        if key in query:
            raise _bad("duplicate query parameter")
        query[key] = value
    found: dict[str, str | None] = {}
    for name, given in (("user", parts.username), ("password", parts.password)):
        inside = _decoded(given, name) if given else None
        if inside and name in query:
            raise _bad(f"{name} given both in the URL and as a query parameter")
        found[name] = inside or query.get(name)
    database = _decoded(parts.path.removeprefix("/"), "database name")
    if "/" in database:
        raise _bad('postgres database name contains "/"')
    sslmode = query.get("sslmode", "disable")
    port = 5432 if port is None else port
    wrong = [n for n, ok in (("host", bool(parts.hostname)), ("port", 1 <= port <= 65535), ("database", bool(database)), ("user", found["user"] != ""), ("password", found["password"] != ""), ("sslmode", sslmode in SSL_MODES)) if not ok]
    if wrong:
        raise _bad(f"postgres URL has invalid {', '.join(wrong)}")
    return PostgresConfig(parts.hostname or "", port, database, found["user"], found["password"], sslmode)


def parse_database_url(url: str) -> SqliteConfig | PostgresConfig:
    if not isinstance(url, str) or not url.strip():
        raise _bad("value is empty")
    url = url.strip()
    scheme, colon, rest = url.partition(":")
    if not colon or not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme):
        raise _bad("no URL scheme (expected file:, sqlite:, postgres: or postgresql:)")
    if scheme.lower() in ("file", "sqlite"):
        return _sqlite(rest)
    if scheme.lower() in ("postgres", "postgresql"):
        return _postgres(url)
    shown = scheme.lower() if len(scheme) <= 20 else "?"
    raise _bad(f'unsupported scheme "{shown}" (expected file, sqlite, postgres or postgresql)')


def describe(config: SqliteConfig | PostgresConfig | str) -> str:
    """Log-safe text. A URL that does not parse keeps its scheme and host only."""
    if isinstance(config, str):
        try:
            return describe(parse_database_url(config))
        except ToolkitError:
            found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://(.*)", config, re.S)
            if not found:
                return "<unparseable DATABASE_URL>"
            secret, at, host = found[2].rpartition("@")
            return f"{found[1]}://{'***@' * bool(at)}{re.split(r'[/?#;\s]', host, maxsplit=1)[0]}"
    if isinstance(config, SqliteConfig):
        return f"sqlite:{config.path}"
    host = f"[{config.host}]" if ":" in config.host else config.host
    auth = (quote(config.user, safe="") if config.user else "") + ":***" * bool(config.password)
    return f"postgres://{auth}{'@' * bool(auth)}{host}:{config.port}/{quote(config.database, safe='')}?sslmode={config.sslmode}"


def _upstream(url: str) -> PostgresConfig:
    parts = urlsplit(url)
    kept = "&".join(p for p in parts.query.split("&") if p and p.split("=")[0] not in DRIVER_KEYS)
    config = parse_database_url(urlunsplit(parts._replace(query=kept)))
    if not isinstance(config, PostgresConfig):
        raise ToolkitError("INVALID_OPTIONS", "A PostgreSQL URL is required")
    return config


def runtime_database_url(env: Mapping[str, str], purpose: str = "runtime", pooling: str = "required") -> str:
    """The URL that a process of this purpose connects to. Only runtime work goes through a pool, and the
    pool has to lead to the same database with the same credentials and schema."""
    if purpose not in ("runtime", "migration", "backup", "session") or pooling not in ("required", "preferred", "off"):
        raise ToolkitError("INVALID_OPTIONS", "Unsupported connection purpose or pooling policy")
    direct = env.get("DATABASE_URL")
    if not direct:
        raise ToolkitError("INVALID_OPTIONS", "DATABASE_URL is required")
    if re.match(r"(file|sqlite):", direct, re.I):
        return direct
    upstream = _upstream(direct)
    if purpose != "runtime" or pooling == "off":
        return direct
    pooled = env.get("POOLED_DATABASE_URL")
    if not pooled:
        if pooling == "preferred":
            return direct
        raise ToolkitError("INVALID_OPTIONS", "POOLED_DATABASE_URL is required for PostgreSQL runtime connections")
    through = _upstream(pooled)

    def schema(url: str) -> str:
        return dict(parse_qsl(urlsplit(url).query)).get("schema", "public")

    if (through.database, through.user, through.password, schema(pooled)) != (upstream.database, upstream.user, upstream.password, schema(direct)):
        raise ToolkitError("INVALID_OPTIONS", "Pooled connection must preserve the direct database, credentials and schema")
    return pooled


def export_source_url(raw: str) -> str:
    """An application's URL as the parser takes it: keys of ORM clients and ``schema=public`` dropped. Another
    schema is refused; a URL with nothing to drop stays as it is."""
    parts = urlsplit(raw)
    if parts.scheme not in ("postgres", "postgresql"):
        return raw
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    schema = dict(pairs).get("schema")
    if schema not in (None, "public"):
        raise Refused(Refusal("source-url-invalid"), "source-url-invalid: only the public schema is exported")
    kept = [(k, v) for k, v in pairs if k not in DRIVER_KEYS]
    return raw if kept == pairs else urlunsplit(parts._replace(query=urlencode(kept)))


def scrubbed(text: str, url: str | None = None, secrets: tuple[str, ...] = ()) -> str:
    """A message without the URL, its password in either spelling, further secrets, and any userinfo."""
    hidden = [url, *secrets]
    if url:
        password = urlsplit(url).password or ""
        hidden += [unquote(password), password]
    for secret in hidden:
        if secret:
            text = text.replace(secret, "[redacted]")
    return re.sub(r"([a-z][a-z0-9+.-]*://)[^\s/@]*@", r"\1[redacted]@", text, flags=re.I)


def read_env_file(path: str) -> dict[str, str]:
    """``NAME=value`` lines; quotes around a value are dropped, comments and blank lines skipped. The process's
    own environment is not touched."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except (OSError, UnicodeDecodeError):
        raise Refused(Refusal("source-url-missing"), "source-url-missing: the env file cannot be read") from None
    out = {}
    for line in lines:
        found = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$", line)
        if found and not line.lstrip().startswith("#"):
            value = found[2]
            quote_mark = value[:1]
            if quote_mark in ("'", '"') and (end := value.find(quote_mark, 1)) > 0:
                value = value[1:end]
            else:
                value = re.sub(r"\s+#.*$", "", value)
            out[found[1]] = value
    return out
