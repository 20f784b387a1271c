"""Composite jobs: decision audits, lien waterfall, pricing checks, operations scorecard."""
