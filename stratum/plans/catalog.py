"""Imports every query module so their ``@query`` registrations run."""

from stratum.plans import q_filter  # noqa: F401
from stratum.plans import q_tokens  # noqa: F401
from stratum.plans import q_packing  # noqa: F401
from stratum.plans import q_vq  # noqa: F401
from stratum.plans import q_series  # noqa: F401
from stratum.plans import q_sources  # noqa: F401
from stratum.plans import q_stream  # noqa: F401
from stratum.plans import q_udf  # noqa: F401
