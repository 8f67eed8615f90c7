"""Column builders: rules, text, policy, prompts, response validation."""
