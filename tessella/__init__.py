"""Analytics for developer artefacts and training corpora, on the DataFrame API."""
