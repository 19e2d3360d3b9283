"""End-to-end compositions of the operators (profiles, site runs, link crawls)."""
