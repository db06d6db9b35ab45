"""Configuration text for a PgBouncer in front of several databases. Pure: nothing is installed or written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from concordat.errors import ToolkitError
from concordat.sources.urls import _upstream


@dataclass(frozen=True)
class PooledDatabase:
    name: str
    url: str
    pool_size: int = 5
    reserve_pool_size: int = 2
    max_server_connections: int | None = None
    mode: str = "session"


@dataclass(frozen=True)
class PoolFiles:
    config: str
    auth: str
    runtime_urls: dict[str, str]
    server_connection_cap: int


def _bad(message: str) -> ToolkitError:
    return ToolkitError("INVALID_OPTIONS", message)


def _whole(value: object, low: int, high: int = 1_000_000) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise _bad("Invalid pool size, port, or connection budget")
    return value


def _line(value: str) -> str:
    if re.search(r"[\r\n\0]", value):
        raise _bad("Configuration values cannot contain line breaks or NUL")
    return value


def _path(value: str) -> str:
    if not value.startswith("/") or re.search(r"[\s'\"#;]", value):
        raise _bad("Configuration paths must be absolute POSIX paths without whitespace or delimiters")
    return value


def _quoted(value: str) -> str:
    return "'" + _line(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _runtime_url(url: str, user: str, password: str, port: int) -> str:
    parts = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(parts.query) if k not in ("user", "password", "sslmode")] + [("sslmode", "disable")]
    return urlunsplit((parts.scheme, f"{quote(user, safe='')}:{quote(password, safe='')}@127.0.0.1:{port}", parts.path, urlencode(query), ""))


def render_pool(
    databases: list[PooledDatabase],
    server_connection_budget: int,
    *,
    listen_port: int = 6432,
    max_client_connections: int = 200,
    auth_file: str = "/etc/concordat-pool/users.txt",
    socket_directory: str = "/run/concordat-pool",
    server_tls_ca_file: str | None = None,
) -> PoolFiles:
    """The caps of all databases together have to fit the budget; TLS to the servers is never weakened."""
    if not databases:
        raise _bad("At least one database is required")
    budget, port = _whole(server_connection_budget, 1), _whole(listen_port, 1, 65535)
    clients = _whole(max_client_connections, 1)
    users: dict[str, str] = {}
    urls: dict[str, str] = {}
    modes: set[str] = set()
    lines, cap = [], 0
    for d in databases:
        up = _upstream(d.url)
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_-]*", d.name) or d.name in urls or d.name != up.database:
            raise _bad("Database names must be unique safe identifiers matching their upstream database")
        if not up.user or not up.password:
            raise _bad("Each pooled database requires an explicit user and password")
        if users.setdefault(up.user, up.password) != up.password:
            raise _bad("Conflicting credentials for a shared database role")
        modes.add(up.sslmode)
        size, reserve = _whole(d.pool_size, 1), _whole(d.reserve_pool_size, 0)
        most = _whole(size + reserve if d.max_server_connections is None else d.max_server_connections, 1)
        if size + reserve > most or most > clients:
            raise _bad("Database capacity must contain its normal and reserve pools and fit the client limit")
        if d.mode not in ("transaction", "session"):
            raise _bad("Unsupported pool mode")
        cap += most
        urls[d.name] = _runtime_url(d.url, up.user, up.password, port)
        lines.append(f"{d.name} = host={_quoted(up.host)} port={up.port} dbname={_quoted(up.database)} pool_size={size} reserve_pool_size={reserve} max_db_connections={most} pool_mode={d.mode}")
    if cap > budget:
        raise _bad("Per-database connection caps exceed the assigned server budget")
    if len(modes) != 1:
        raise _bad("Different upstream TLS modes require separate PgBouncer instances")
    mode = modes.pop()
    if mode.startswith("verify-") and not server_tls_ca_file:
        raise _bad("Verified upstream TLS requires an explicit CA file")
    settings = {
        "listen_addr": "127.0.0.1",
        "listen_port": port,
        "unix_socket_dir": _path(socket_directory),
        "unix_socket_mode": "0700",
        "auth_type": "scram-sha-256",
        "auth_file": _path(auth_file),
        "pool_mode": "session",
        "max_client_conn": clients,
        "max_prepared_statements": 100,
        "track_extra_parameters": "statement_timeout,bytea_output,extra_float_digits",
        "server_tls_sslmode": mode,
    } | ({"server_tls_ca_file": _path(server_tls_ca_file)} if server_tls_ca_file else {})
    settings |= {"dns_max_ttl": 15, "query_wait_timeout": 120}
    config = "\n".join(["[databases]", *lines, "", "[pgbouncer]", *[f"{k} = {v}" for k, v in settings.items()], ""])
    auth = "".join('"{}" "{}"\n'.format(*(_line(x).replace('"', '""') for x in pair)) for pair in users.items())
    return PoolFiles(config, auth, urls, cap)
