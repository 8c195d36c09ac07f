"""From facts to a decision: plan, capability status, reflection, score, approval, full audit."""
