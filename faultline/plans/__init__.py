"""Multi-operator jobs and the catalogue of registered queries."""
