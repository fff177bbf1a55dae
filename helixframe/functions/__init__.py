"""Column functions: flags, CIGAR arithmetic, tags, numbers in log space. All of them stay in the JVM."""
