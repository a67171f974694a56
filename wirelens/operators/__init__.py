"""DataFrame to DataFrame operators over packets, flows, names, streams and findings."""
