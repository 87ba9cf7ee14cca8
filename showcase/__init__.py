"""The test tables seen as entities, and one query per operator with its SQL counterpart."""
