"""Business marts built from the operators. Amounts are exact decimals until the last step."""
