"""All corpus queries; importing a module registers its query."""

from sensorgate.llm import bpe_automaton, embeddings, fill_middle, html_text, minhash, mixing, order_minhash, packing, quality, spelling, suffixes, token_files, urls  # noqa: F401
from sensorgate.llm.common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
