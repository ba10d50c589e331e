"""Plans that combine operators: recursion, rendezvous, derived relations and the queries."""
