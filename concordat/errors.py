"""Reasons for refusing, as data.

A refusal names a code and the identity it concerns, never a value, a URL or driver text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every code a refusal may carry, by the step that finds it.
REFUSAL_CODES: dict[str, tuple[str, ...]] = {
    "snapshot": (
        "writers-not-stopped", "live-database-missing", "live-checkpoint-blocked", "live-writer-active", "live-changed-during-snapshot",
        "snapshot-failed", "snapshot-integrity-failed", "snapshot-foreign-key-violation", "snapshot-not-utf8",
    ),
    "source": (
        "source-nul-in-text", "source-invalid-utf8", "source-read-failed", "varchar-overflow", "integer-width", "orphan-foreign-keys",
        "codec-null", "codec-invalid", "codec-lossy",
    ),
    "target": (
        "target-url-missing", "target-url-invalid", "target-not-postgres", "target-connect-failed", "target-identity-unreadable",
        "target-in-recovery", "topology-invalid", "production-unconfirmed",
    ),
    "schema": (
        "manifest-invalid", "primary-key-mismatch", "primary-key-order-unsupported", "nullability-mismatch", "partitioned-table",
        "inherited-table", "trigger-present", "rule-present", "row-security-enabled", "foreign-key-not-valid", "constraint-has-comment",
        "event-trigger-present", "publication-covers-table", "subscription-present", "sequence-unowned", "sequence-shared",
        "sequence-dynamic-default", "volatile-expression", "sequence-cycles", "sequence-out-of-range",
        "incoming-reference-from-uncopied-table", "foreign-key-to-skipped-table",
    ),
    "state": (
        "not-owner", "no-create-privilege", "receipt-table-invalid", "target-not-empty", "archiver-failing", "replication-slot-lag",
        "preflight-failed",
    ),
    "reverse": (
        "source-url-missing", "source-url-invalid", "source-not-postgres", "source-in-recovery", "sqlite-target-exists",
        "sqlite-template-missing", "sqlite-template-invalid", "sqlite-template-not-empty", "sqlite-foreign-key-violation",
        "sqlite-integrity-failed", "sqlite-write-failed", "invalid-option", "unexpected-value-format", "ledger-mismatch",
        "tls-ca-unreadable", "tls-ca-missing",
    ),
    "execution": ("lock-timeout", "load-failed", "verification-mismatch", "foreign-keys-changed", "commit-failed", "execute-failed"),
}
ALL_CODES = frozenset(code for codes in REFUSAL_CODES.values() for code in codes)

#: Classes of a value that a codec cannot carry, and the refusals they become.
CODEC_NULL, CODEC_INVALID, CODEC_LOSSY = "CODEC_NULL", "CODEC_INVALID", "CODEC_LOSSY"
CODEC_REFUSALS = {CODEC_NULL: "codec-null", CODEC_INVALID: "codec-invalid", CODEC_LOSSY: "codec-lossy"}

REFUSAL_SCHEMA = "code string, table string, column string, object string, ord long"


class ToolkitError(Exception):
    """An error with a code of its own: a bad option, URL or manifest."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Refusal:
    code: str
    table: str | None = None
    column: str | None = None
    object: str | None = None

    def __post_init__(self):
        if self.code not in ALL_CODES:
            raise ValueError(f"unknown refusal code {self.code}")

    def __str__(self) -> str:
        identity = ".".join(x for x in (self.table, self.column) if x is not None)
        return " ".join(x for x in (self.code, identity, "" if self.object is None else f"({self.object})") if x)


class Refused(ToolkitError):
    """Raised when nothing can go on; printing it is safe."""

    def __init__(self, refusal: Refusal, message: str | None = None):
        super().__init__("CLONE_REFUSED", message or str(refusal))
        self.refusal = refusal


class OutcomeError(ToolkitError):
    """A publication whose fate is ``aborted`` (nothing changed) or ``unknown`` (look before trying again)."""

    def __init__(self, outcome: str, run_id: str):
        super().__init__("CLONE_OUTCOME", f"commit {outcome} (run {run_id})")
        self.outcome, self.run_id = outcome, run_id


def to_refusal(error: BaseException, fallback: str = "preflight-failed") -> Refusal:
    """Map anything that escapes onto the allowed codes; other errors keep no detail at all."""
    return error.refusal if isinstance(error, Refused) else Refusal(fallback)


def refusals(spark: SparkSession, found: list[Refusal]) -> DataFrame:
    return spark.createDataFrame([(r.code, r.table, r.column, r.object, k) for k, r in enumerate(found)], REFUSAL_SCHEMA)


def describe_refusal(code: Column, table: Column, column: Column, obj: Column) -> Column:
    """The printed form of refusals that are rows: empty parts leave no space behind."""
    identity = F.concat_ws(".", table, column)
    return F.concat_ws(" ", code, F.when(identity != "", identity), F.when(obj.isNotNull(), F.concat(F.lit("("), obj, F.lit(")"))))
