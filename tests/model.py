"""A dictionary model of the log's semantics, the third opinion beside Spark and SQL."""


def resolve(ops, horizon=None, merge=lambda base, operands: (base or 0) + sum(operands)):
    """ops: (key, seq, op, value, end), in any order; {key: (value, seq)} at the horizon."""
    state, last = {}, {}
    for key, seq, op, value, end in sorted(ops, key=lambda o: o[1]):
        if horizon is not None and seq > horizon:
            break
        if op == "delete_range":
            for k in [k for k in last if key <= k < end]:
                state.pop(k, None)
                del last[k]
            continue
        if op == "put":
            state[key] = (value, [])
        elif op == "delete":
            state.pop(key, None)
        else:
            base, operands = state.get(key, (None, []))
            state[key] = (base, [*operands, value])
        last[key] = seq
    return {k: (merge(b, o) if o else b, last[k]) for k, (b, o) in state.items()}
