"""All registered queries by area; importing this package fills the registry."""

from cobaltmill.catalog import (  # noqa: F401
    charting, cleaning, events, files, payments, prefixes, requests, retrieval, streams, texts,
)
from cobaltmill.catalog.registry import ORACLES, QUERIES  # noqa: F401
