"""Spark-native governance of prompts and model responses.

Tables or streams of requests are decided on in one DataFrame plan, sealed into
SHA-256 hash chains, verified in parallel and reported on.
"""

from wardline.operators.decide import decide
from wardline.operators.ledger import seal, verify_chain
from wardline.plans.gateway import gateway_ledger
from wardline.session import build_session

__all__ = ["build_session", "decide", "gateway_ledger", "seal", "verify_chain"]
