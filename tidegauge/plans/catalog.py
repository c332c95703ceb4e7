"""All registered queries; importing the family modules fills the registry."""

from tidegauge.plans import events, files, interest, ledgers, reports, spatial, streams, temporal, values  # noqa: F401
from tidegauge.plans.registry import ORACLES, QUERIES  # noqa: F401
