"""DataFrame operators over pixels, tags, jobs, ledgers and audits."""
