"""DataFrame operators: diffs, source lines, rules, review roll-ups, rewrites, verification, logs, answers."""
