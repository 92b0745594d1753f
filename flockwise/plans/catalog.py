"""Every query of the library with its SQL."""

from ..streaming import stateful, telemetry
from . import conditions, events, frames, records, sweeps

FLAGSHIP = "frame_mutual_information"


def queries() -> dict:
    return {**frames.QUERIES, **sweeps.QUERIES, **conditions.QUERIES, **events.QUERIES, **records.QUERIES, **telemetry.QUERIES, **stateful.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**frames.ORACLE, **sweeps.ORACLE, **conditions.ORACLE, **events.ORACLE, **records.ORACLE, **telemetry.ORACLE, **stateful.ORACLE}
