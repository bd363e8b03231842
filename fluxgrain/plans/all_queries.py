"""Imports every plan module, so that the registry is full."""

from fluxgrain.plans import events, files, keyed, labels, pairs, recording, signals, spatial, streams, tables  # noqa: F401

FLAGSHIP = events.q_range_count
