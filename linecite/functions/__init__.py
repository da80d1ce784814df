"""Row-local column expressions. Nothing here shuffles or leaves the JVM."""
