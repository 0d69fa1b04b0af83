"""Long-running forms: upsert streams, visited sets, the page state machine, expiring caches."""
