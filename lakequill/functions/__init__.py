"""Column expressions: text keys, tokens, answers, questions, vectors."""
