"""Rules, evaluation, reports, audits and gates."""
