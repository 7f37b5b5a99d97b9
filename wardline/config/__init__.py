"""Paths of the shipped configuration.

The policy and the bias lexicon hold fixed values (term lists, messages, thresholds).
"""

from pathlib import Path

_HERE = Path(__file__).parent

BASELINE_POLICY = str(_HERE / "policies" / "global_baseline.json")
BIAS_LEXICON = str(_HERE / "bias_lexicon.json")
CONTROL_STATE = str(_HERE / "control_state.json")
REGULATORY_CORPUS = str(_HERE / "regulatory_corpus.jsonl")

# Names under which a policy may be asked for.
POLICY_ALIASES = {
    "eu_ai_act_high_risk": BASELINE_POLICY,
    "nist_ai_rmf": BASELINE_POLICY,
    "global_baseline": BASELINE_POLICY,
}
